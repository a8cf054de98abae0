"""Least squares, Granger-type tests, unit-root tests and a logit on NumPy."""

from __future__ import annotations

import math

import numpy as np

from tidemark.functions.special import chi2_sf, f_sf, norm_cdf


def ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, residuals, sum of squared residuals)."""
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    return b, e, float(e @ e)


def lag_matrix(x: np.ndarray, p: int) -> np.ndarray:
    """Columns x(t-1) ... x(t-p) for t = p ... n-1."""
    return np.column_stack([x[p - k : len(x) - k] for k in range(1, p + 1)])


def _complete(*series) -> list[np.ndarray]:
    a = np.column_stack([np.asarray(s, float) for s in series])
    a = a[np.all(np.isfinite(a), axis=1)]
    return list(a.T)


def block_f(y, restricted, extra) -> tuple[float, float, float, int]:
    """(F, p, sum of squares of the full model, its parameters) for leaving out the columns ``extra``."""
    full = np.column_stack([restricted, extra])
    _, _, s1 = ols(y, full)
    _, _, s0 = ols(y, restricted)
    q, df = extra.shape[1], len(y) - full.shape[1]
    if df <= 0 or s1 <= 0:
        return math.nan, math.nan, s1, full.shape[1]
    f = max((s0 - s1) / q / (s1 / df), 0.0)
    return f, float(f_sf(f, q, df)), s1, full.shape[1]


def granger(y, x, maxlag: int, least: int) -> dict | None:
    """Smallest p over lags 1..maxlag of the SSR F-test that x's lags leave y's equation; lags by AIC and BIC too."""
    y, x = _complete(y, x)
    n = len(y)
    if n < least:
        return None
    best = {"f": math.nan, "p": math.nan, "lag": None, "lag_aic": None, "lag_bic": None, "n": n}
    aic = bic = math.inf
    for p in range(1, maxlag + 1):
        t = n - p
        if t <= 2 * p + 1:
            break
        own = np.column_stack([lag_matrix(y, p), np.ones(t)])
        f, pv, s1, k = block_f(y[p:], own, lag_matrix(x, p))
        ll = -t / 2 * (math.log(2 * math.pi * s1 / t) + 1) if s1 > 0 else math.inf
        a, b = -2 * ll + 2 * k, -2 * ll + k * math.log(t)
        if a < aic:
            aic, best["lag_aic"] = a, p
        if b < bic:
            bic, best["lag_bic"] = b, p
        if pv == pv and (best["lag"] is None or pv < best["p"]):
            best.update(f=f, p=pv, lag=p)
    return best


def conditional_granger(y, x, controls: list, maxlag: int, least: int = 50, contemporaneous: bool = False) -> dict:
    """As ``granger`` given lags of controls, and with ``contemporaneous`` their present values."""
    series = _complete(y, x, *controls)
    y, x, controls = series[0], series[1], series[2:]
    n = len(y)
    best = {"f": math.nan, "p": math.nan, "lag": None, "n": n}
    if n < least:
        return best
    for p in range(1, maxlag + 1):
        t = n - p
        own = [np.ones((t, 1)), lag_matrix(y, p)]
        for z in controls:
            own += [z[p:, None]] * contemporaneous + [lag_matrix(z, p)]
        restricted = np.column_stack(own)
        needed = restricted.shape[1] + p + 5 if contemporaneous else 3 * p + 5
        if t < needed:
            continue
        f, pv, _, _ = block_f(y[p:], restricted, lag_matrix(x, p))
        if pv == pv and (best["lag"] is None or pv < best["p"]):
            best.update(f=f, p=pv, lag=p)
    return best


def var_order(data: np.ndarray, maxlag: int) -> int:
    """The order of a vector autoregression with constant by AIC, all on the same sample; at least 1."""
    n, k = data.shape
    t = n - maxlag
    best = (math.inf, 1)
    for p in range(0, maxlag + 1):
        x = np.column_stack([np.ones(t), *(data[maxlag - j : n - j] for j in range(1, p + 1))])
        b = np.linalg.lstsq(x, data[maxlag:], rcond=None)[0]
        e = data[maxlag:] - x @ b
        sign, logdet = np.linalg.slogdet(e.T @ e / t)
        if sign > 0 and (score := logdet + 2 / t * (p * k * k + k)) < best[0]:
            best = (score, p)
    return max(best[1], 1)


def toda_yamamoto(y, x, maxlag: int, d_max: int = 1) -> dict:
    """Wald test (HC1) of the first p lags of x in y's equation augmented with d_max more lags of both."""
    y, x = _complete(y, x)
    n = len(y)
    out = {"wald": math.nan, "p": math.nan, "order": None, "lags": None, "n": n}
    if n < 50:
        return out
    p = var_order(np.column_stack([y, x]), min(maxlag, n // 5))
    k = p + d_max
    t = n - k
    out.update(order=p, lags=k, n=t)
    if t < 2 * k + 5:
        return out
    design = np.column_stack([np.ones(t), lag_matrix(y, k), lag_matrix(x, k)])
    b, e, _ = ols(y[k:], design)
    inv = np.linalg.pinv(design.T @ design)
    cov = inv @ (design.T * e**2 @ design) @ inv * t / (t - design.shape[1])
    at = slice(1 + k, 1 + k + p)
    wald = float(b[at] @ np.linalg.solve(cov[at, at], b[at]))
    out.update(wald=wald, p=chi2_sf(wald, p))
    return out


# MacKinnon (1994) response surface for a constant, one variable; KPSS (1992) critical values.
_TAU_STAR, _TAU_MIN, _TAU_MAX = -1.61, -18.83, 2.74
_TAU_SMALL = (2.1659, 1.4412, 0.038269)
_TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
_KPSS_CRITICAL, _KPSS_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)


def adf(x) -> tuple[float, float, int]:
    """(statistic, p, lags) of the augmented Dickey-Fuller test with a constant; lags by AIC on one sample."""
    (x,) = _complete(x)
    n = len(x)
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    d = np.diff(x)

    def fit(p: int, skip: int):
        t = len(d) - skip
        cols = [x[skip:-1], np.ones(t)] + [d[skip - j : len(d) - j] for j in range(1, p + 1)]
        design = np.column_stack([cols[0], *cols[2:], cols[1]])
        b, _, s = ols(d[skip:], design)
        return b, s, design

    def aic(p: int) -> float:
        _, s, design = fit(p, most)
        t = len(design)
        return t * (math.log(2 * math.pi * s / t) + 1) + 2 * design.shape[1]

    p = min(range(most + 1), key=aic)
    b, s, design = fit(p, p)
    se = math.sqrt(s / (len(design) - design.shape[1]) * np.linalg.pinv(design.T @ design)[0, 0])
    tau = float(b[0] / se)
    if tau > _TAU_MAX:
        return tau, 1.0, p
    if tau < _TAU_MIN:
        return tau, 0.0, p
    surface = _TAU_SMALL if tau <= _TAU_STAR else _TAU_LARGE
    return tau, float(norm_cdf(sum(c * tau**k for k, c in enumerate(surface)))), p


def kpss(x) -> tuple[float, float, int]:
    """(statistic, p between 0.01 and 0.10, lags) of the KPSS test about a constant with automatic Bartlett lags."""
    (x,) = _complete(x)
    n = len(x)
    e = x - x.mean()
    s0, s1 = float(e @ e) / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        c = float(e[i:] @ e[: n - i]) / (n / 2)
        s0, s1 = s0 + c, s1 + i * c
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    long = float(e @ e) + 2 * sum(float(e[i:] @ e[: n - i]) * (1 - i / (lags + 1)) for i in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum()) / n**2 / (long / n)
    return stat, float(np.interp(stat, _KPSS_CRITICAL, _KPSS_P)), lags


def arch_lm(z, lags: int) -> tuple[float, float]:
    """(LM, p): observations after lagging times R squared of squares on their own lags."""
    u = np.asarray(z, float) ** 2
    y = u[lags:]
    _, _, s = ols(y, np.column_stack([np.ones(len(y)), lag_matrix(u, lags)]))
    total = float(((y - y.mean()) ** 2).sum())
    lm = len(y) * (1 - s / total) if total > 0 else 0.0
    return lm, chi2_sf(lm, lags)


def ljung_box(x, lag: int) -> float:
    c = np.asarray(x, float) - np.mean(x)
    n, d = len(c), float(c @ c)
    return n * (n + 2) * sum((float(c[k:] @ c[:-k]) / d) ** 2 / (n - k) for k in range(1, lag + 1))


def logit(y, x) -> tuple[float, float]:
    """(slope, its p) of a logit on a constant and one variable by Newton steps; NaN when the data are separated."""
    y, x = _complete(y, x)
    design, b = np.column_stack([np.ones(len(x)), (x - x.mean()) / (x.std() or 1)]), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -35, 35)))
        info = design.T @ (design * (p * (1 - p))[:, None])
        if np.linalg.cond(info) > 1e12:
            return math.nan, math.nan
        step = np.linalg.solve(info, design.T @ (y - p))
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    if np.abs(b).max() > 25:
        return math.nan, math.nan
    se = math.sqrt(np.linalg.inv(info)[1, 1])
    return float(b[1] / (x.std() or 1)), float(2 * norm_cdf(-abs(b[1] / se)))
