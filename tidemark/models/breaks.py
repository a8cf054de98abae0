"""Change points in the mean: exact optimal segmentation by dynamic programming, and bootstrap intervals."""

from __future__ import annotations

import math

import numpy as np


def _costs(y: np.ndarray):
    s, q = np.concatenate([[0], np.cumsum(y)]), np.concatenate([[0], np.cumsum(y * y)])
    return lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / np.maximum(b - a, 1)


def optimal_segmentations(y: np.ndarray, most: int, least: int) -> list[tuple[float, list[int]]]:
    """(sum of squares, breaks) of the best segmentation with 0, 1, ... ``most`` breaks, segments of ``least`` or more."""
    n, cost = len(y), _costs(np.asarray(y, float))
    ends = np.arange(n + 1)
    best = [np.where(ends >= least, cost(0, ends), np.inf)]
    back: list[np.ndarray] = []
    for k in range(1, most + 1):
        row, where = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for e in range((k + 1) * least, n + 1):
            starts = np.arange(k * least, e - least + 1)
            total = best[-1][starts] + cost(starts, e)
            j = int(np.argmin(total))
            row[e], where[e] = total[j], starts[j]
        best.append(row)
        back.append(where)
    out = []
    for k in range(most + 1):
        if not math.isfinite(best[k][n]):
            continue
        cuts, e = [], n
        for j in range(k - 1, -1, -1):
            e = int(back[j][e])
            cuts.append(e)
        out.append((float(best[k][n]), cuts[::-1]))
    return out


def detect(y, most: int = 5, trim: float = 0.15, penalties: np.ndarray | None = None) -> list[int]:
    """Breaks of the segmentation with the least BIC, among those that are optimal under some penalty of the grid.

    Series below 100 points have none. Segments have at least ``trim`` of the points, and 30.
    """
    y = np.asarray(y, float)
    y = y[np.isfinite(y)]
    n = len(y)
    if n < 100:
        return []
    grid = np.logspace(-2, 4, 60) if penalties is None else penalties
    found = optimal_segmentations(y, min(most + 1, n), max(int(trim * n), 30))
    reached = {int(np.argmin([s + p * len(c) for s, c in found])) for p in grid}
    scored = [(n * math.log(s / n + 1e-12) + (len(c) + 1) * math.log(n), c) for k, (s, c) in enumerate(found) if k in reached and len(c) <= most]
    return min(scored, key=lambda x: x[0])[1] if scored else []


def interval(y, at: int, reps: int = 200, alpha: float = 0.10, seed: int = 42) -> tuple[int, int]:
    """Quantiles of the break's place in resampled residuals, searched within max(10 % of the points, 30) of it."""
    y = np.asarray(y, float)
    y = y[np.isfinite(y)]
    n = len(y)
    a, b = y[:at], y[at:]
    rng, radius = np.random.default_rng(seed), max(int(0.1 * n), 30)
    places = np.arange(max(1, at - radius), min(n - 1, at + radius))
    found = np.empty(reps, int)
    for k in range(reps):
        s = np.concatenate([rng.choice(a - a.mean(), len(a)) + a.mean(), rng.choice(b - b.mean(), len(b)) + b.mean()])
        cost = _costs(s)
        found[k] = places[int(np.argmin(cost(0, places) + cost(places, n)))]
    return int(np.quantile(found, alpha / 2)), int(np.quantile(found, 1 - alpha / 2))
