"""Parameters of a study, passed to operators; nothing is global."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class StudyConfig:
    """Windows are in calendar days around the event day and inclusive at both ends."""

    estimation_days: int = 250
    estimation_min: int = 120
    gap_days: int = 30
    event_min: int = 5
    event_from: int = -5
    event_to: int = 30
    dummy_before: int = 3
    dummy_after: int = 3
    zscore_window: int = 52
    zscore_min: int = 26
    winsor_low: float = 0.005
    winsor_high: float = 0.995
    roll_window: int = 30
    roll_sds: float = 5.0
    seed: int = 42

    @property
    def event_days(self) -> int:
        return self.event_to - self.event_from + 1
