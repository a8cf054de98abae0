"""Distribution functions on NumPy and the standard library alone."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()
_LGAMMA = np.frompyfunc(math.lgamma, 1, 1)
_TINY = 1e-300


def lgamma(x):
    return np.asarray(_LGAMMA(x), float)


def norm_cdf(x):
    return np.asarray(np.frompyfunc(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), 1, 1)(x), float)


def norm_ppf(p: float) -> float:
    if p <= 0 or p >= 1:
        return -math.inf if p <= 0 else math.inf
    return _NORMAL.inv_cdf(p)


def _beta_fraction(a, b, x, rounds: int = 300):
    """Continued fraction of the incomplete beta function (modified Lentz), elementwise."""
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, rounds):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return h


def betainc(a, b, x):
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    shape = x.shape
    a, b, x = a.ravel(), b.ravel(), np.clip(x.ravel(), 0.0, 1.0)
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inside = (y > 0) & (y < 1)
    z = np.where(inside, y, 0.5)
    front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    out = np.where(inside, front * _beta_fraction(p, q, z), np.where(y >= 1, 1.0, 0.0))
    return np.where(flip, 1 - out, out).reshape(shape)


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gammainc_upper(df / 2, x / 2)


def f_sf(f, d1, d2):
    f = np.asarray(f, float)
    return betainc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * np.maximum(f, 0)))


def t_sf2(t, df):
    """Two-sided tail of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2, 0.5, df / (df + t * t))


def t_cdf(t, df):
    t = np.asarray(t, float)
    half = 0.5 * t_sf2(t, df)
    return np.where(t > 0, 1 - half, half)


def t_ppf(p, df: float):
    """Quantiles of Student's t: bisection on the tail in log space, then Newton steps."""
    p = np.asarray(p, float)
    tail = np.minimum(p, 1 - p)
    df = float(df)
    if df == 1:
        x = 1 / np.tan(np.pi * tail)
    elif df == 2:
        x = (1 - 2 * tail) / np.sqrt(2 * tail * (1 - tail))
    else:
        # I_y(df/2, 1/2) = 2 * tail with y = df / (df + x^2); solve on a grid, then polish
        grid = np.concatenate([np.linspace(0, 8, 1601), np.geomspace(8.02, 1e9 ** min(1.0, 3 / df) * 40 + 100, 1200)])
        logs = np.log(np.maximum(0.5 * t_sf2(grid, df), _TINY))
        order = slice(None, None, -1)
        x = np.interp(np.log(np.maximum(tail, _TINY)), logs[order], grid[order])
        const = float(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * math.log(df * math.pi))
        for _ in range(4):
            now = 0.5 * t_sf2(x, df)
            pdf = np.exp(const - (df + 1) / 2 * np.log1p(x * x / df))
            x = np.maximum(x + (now - tail) / np.maximum(pdf, _TINY) * (1 if df else 0), 0)
    return np.where(p < 0.5, -x, x)
