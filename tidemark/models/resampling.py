"""Bootstraps of means and differences; draws depend on the seed alone."""

from __future__ import annotations

import numpy as np

from tidemark.functions.special import norm_cdf, norm_ppf


def _tail(observed: float, draws: np.ndarray) -> float:
    """Twice the share of draws on the other side of zero, at most 1; not smoothed."""
    return float(min(2 * np.mean(draws <= 0 if observed >= 0 else draws >= 0), 1.0))


def difference(a, b, reps: int = 5000, seed: int = 42) -> dict:
    """Difference of means, both groups resampled: percentile interval, unsmoothed two-sided p, spread of the draws.

    The places drawn are fixed by the seed: for each draw those of the first group, then those of the second.
    """
    a, b, rng = np.asarray(a, float), np.asarray(b, float), np.random.default_rng(seed)
    drawn = (a[rng.integers(0, len(a), len(a))].mean() - b[rng.integers(0, len(b), len(b))].mean() for _ in range(reps))
    draws, observed = np.fromiter(drawn, float, reps), a.mean() - b.mean()
    low, high = np.percentile(draws, [2.5, 97.5])
    p = _tail(observed, draws)
    return {"diff": float(observed), "ci_low": float(low), "ci_high": float(high), "p_two": p, "p_one": p / 2, "se": float(draws.std())}


def _row_values(rows: np.ndarray, statistic) -> np.ndarray:
    """The statistic of each row; means and sums take all rows at once."""
    return statistic(rows, axis=1) if statistic in (np.mean, np.sum, np.median) else np.apply_along_axis(statistic, 1, rows)


def _without_one(x: np.ndarray, statistic) -> np.ndarray:
    """The statistic of the sample without each of its values in turn; of means and sums from the total."""
    if statistic is np.sum:
        return x.sum() - x
    if statistic is np.mean:
        return (x.sum() - x) / (len(x) - 1)
    keep = ~np.eye(len(x), dtype=bool)
    return np.array([statistic(x[k]) for k in keep])


def acceleration(influence: np.ndarray) -> float:
    """A sixth of the skewness of the jackknife's influence values, over the root of their number (Efron 1987)."""
    spread = float(np.sqrt(np.mean(influence**2)))
    return float(np.mean((influence / spread) ** 3) / (6 * np.sqrt(len(influence)))) if spread else 0.0


def bca(x, reps: int = 5000, confidence: float = 0.95, seed: int = 42, statistic=np.mean) -> dict:
    """Efron's bias-corrected accelerated interval of a statistic, and the unsmoothed two-sided p of zero.

    The interval's ends are the draws' quantiles at the levels of ``bca_level``. One matrix of drawn places, by row, is
    all that depends on the seed.
    """
    x = np.asarray(x, float)
    places = np.random.default_rng(seed).integers(0, len(x), (reps, len(x)))
    draws, observed = np.sort(_row_values(x[places], statistic)), float(statistic(x))
    rank = np.searchsorted(draws, observed)  # draws below the estimate
    bias = float(norm_ppf(rank / reps)) if 0 < rank < reps else 0.0
    jack = _without_one(x, statistic)
    skew = acceleration(jack.mean() - jack)
    ends = [bca_level(z, bias, skew) for z in (norm_ppf((1 - confidence) / 2), norm_ppf((1 + confidence) / 2))]
    low, high = np.quantile(draws, ends)
    return {"statistic": observed, "ci_low": float(low), "ci_high": float(high), "sd": float(draws.std()), "p": _tail(observed, draws), "bias": bias, "acceleration": skew}


def bca_level(z: float, bias: float, skew: float) -> float:
    """The level of the draws' quantile that stands for the normal quantile z."""
    shifted = bias + z
    return float(norm_cdf(bias + shifted / max(1 - skew * shifted, 1e-12)))


def did(cells: dict[str, np.ndarray], reps: int = 5000, seed: int = 42) -> dict:
    """Difference in differences of four cells, each resampled on its own."""
    rng, order = np.random.default_rng(seed), ("infra_pre", "infra_post", "reg_pre", "reg_post")
    value = lambda m: (m["infra_post"] - m["infra_pre"]) - (m["reg_post"] - m["reg_pre"])
    observed = float(value({k: cells[k].mean() for k in order}))
    draws = np.array([value({k: rng.choice(cells[k], size=len(cells[k]), replace=True).mean() for k in order}) for _ in range(reps)])
    low, high = np.percentile(draws, [2.5, 97.5])
    return {"did": observed, "ci_low": float(low), "ci_high": float(high), "p": _tail(observed, draws), "sd": float(draws.std())}


def basic_interval(observed: float, draws: np.ndarray, level: float = 0.95) -> tuple[float, float, float]:
    """(low, high, median bias): the reflected interval of draws around an estimate."""
    q = np.nanpercentile(draws, [50 * (1 - level), 100 - 50 * (1 - level)])
    return float(2 * observed - q[1]), float(2 * observed - q[0]), float(np.nanmedian(draws) - observed)
