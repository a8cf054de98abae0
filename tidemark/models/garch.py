"""GJR-GARCH with exogenous variance terms and Student-t errors: recursion, likelihood, constrained fit, standard errors.

The recursion v(t) = u(t) + beta v(t-1) is linear while its floor is not touched, so it is evaluated as a parallel
prefix (doubling) over whole arrays. A path that touches the
floor is evaluated step by step. The gradient needs one more recursion, backwards, whatever the number of parameters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from tidemark.functions import labels
from tidemark.functions.special import lgamma, t_sf2

FLOOR = 1e-8
STATIONARY = 0.999
PENALTY = 1e8
NAMES = ("omega", "alpha", "gamma", "beta", "nu")


def linear_recursion(u: np.ndarray, beta: float) -> np.ndarray:
    """v with v[0] = u[0] and v[t] = u[t] + beta v[t-1], along the first axis."""
    v, step, b = u.copy(), 1, beta
    while step < len(v) and abs(b) > 1e-18:
        v[step:] = v[step:] + b * v[:-step]
        step, b = step * 2, b * b
    return v


@dataclass
class Data:
    """Demeaned returns of one series and its regressors. ``leverage``: whether gamma is fitted."""

    returns: np.ndarray
    exog: np.ndarray
    leverage: bool = True
    max_beta: float = 0.95
    stationary: float = STATIONARY

    def __post_init__(self):
        self.returns = np.asarray(self.returns, float)
        self.exog = np.asarray(self.exog, float).reshape(len(self.returns), -1)
        self.mean = float(self.returns.mean())
        self.resid = self.returns - self.mean
        self.var0 = float(np.var(self.returns))
        self.square = self.resid**2
        self.down = np.where(self.resid < 0, self.square, 0.0)
        n, m = self.exog.shape
        lagged = np.zeros((n, 3 + m))
        lagged[1:, 0] = 1
        lagged[1:, 1] = self.square[:-1]
        lagged[1:, 2] = self.down[:-1]
        lagged[1:, 3:] = self.exog[1:]
        self.drivers = lagged  # of omega, alpha, gamma and the exogenous terms

    @property
    def size(self) -> int:
        return 5 + self.exog.shape[1]


def variance(data: Data, p: np.ndarray) -> np.ndarray:
    """The conditional variance, starting at the population variance and never below the floor."""
    u = data.drivers @ np.concatenate([p[:3], p[5:]])
    u[0] = data.var0
    v = linear_recursion(u, p[3])
    if np.all(v >= FLOOR):
        return v
    out, now, beta = [data.var0], data.var0, float(p[3])
    for x in u[1:].tolist():
        now = x + beta * now
        if not now >= FLOOR:
            now = FLOOR
        out.append(now)
    return np.array(out)


def _density(data: Data, v: np.ndarray, nu: float) -> float:
    z = data.square / v
    const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
    return float(len(v) * const - 0.5 * np.log(v).sum() - (nu + 1) / 2 * np.log1p(z / (nu - 2)).sum())


def negative_loglik(data: Data, p: np.ndarray) -> float:
    if not p[4] > 2:
        return PENALTY
    with np.errstate(all="ignore"):
        v = variance(data, p)
        if not np.all(np.isfinite(v)):
            return PENALTY
        out = -_density(data, v, p[4])
    return out if math.isfinite(out) else PENALTY


def _digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def gradient(data: Data, p: np.ndarray) -> tuple[float, np.ndarray]:
    """(negative log-likelihood, its gradient). On the floor the derivative of the variance is taken as on the path."""
    with np.errstate(all="ignore"):
        v = variance(data, p)
        nu = p[4]
        if not (nu > 2 and np.all(np.isfinite(v))):
            return PENALTY, np.zeros(len(p))
        z = data.square / v
        weight = (nu + 1) * z / (nu - 2 + z)
        by_v = np.where(v > FLOOR, 0.5 * (weight - 1) / v, 0.0)
        # What a driver at t adds to all later variances, weighted: the recursion run backwards.
        later = linear_recursion(by_v[::-1], p[3])[::-1]
        told = later @ data.drivers
        g = np.concatenate([told[:3], [later[1:] @ v[:-1]], told[3:]])
        by_nu = len(v) * (0.5 * _digamma((nu + 1) / 2) - 0.5 * _digamma(nu / 2) - 0.5 / (nu - 2)) - 0.5 * np.log1p(z / (nu - 2)).sum() + (nu + 1) / 2 * (z / ((nu - 2) * (nu - 2 + z))).sum()
        f = -_density(data, v, nu)
    out = -np.concatenate([g[:4], [by_nu], g[4:]])
    if not (math.isfinite(f) and np.all(np.isfinite(out))):
        return PENALTY, np.zeros(len(p))
    return f, out


@dataclass
class Fit:
    params: np.ndarray
    negll: float
    ok: bool
    starts: int = 1
    converged: int = 0
    std_errors: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def persistence(self) -> float:
        return float(self.params[1] + self.params[3] + abs(self.params[2]) / 2)


def _box(data: Data) -> tuple[np.ndarray, np.ndarray]:
    return np.array([FLOOR, -0.5, FLOOR, 2.1]), np.array([0.3, 0.5, data.max_beta, 50.0])


class _Space:
    """Unbounded coordinates: log omega, logit within the box for alpha, gamma, beta, nu, scaled exogenous terms."""

    def __init__(self, data: Data):
        self.low, self.high = _box(data)
        self.scale = max(data.var0, 1e-6)
        self.data = data

    def out(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parameters, their derivatives by coordinate)."""
        s = 1 / (1 + np.exp(-np.clip(z[1:5], -40, 40)))
        inner = self.low + (self.high - self.low) * s
        slope = (self.high - self.low) * s * (1 - s)
        omega = FLOOR + self.scale * math.exp(min(z[0], 50))
        p = np.concatenate([[omega], inner, z[5:] * self.scale])
        d = np.concatenate([[omega - FLOOR], slope, np.full(len(z) - 5, self.scale)])
        if not self.data.leverage:
            p[2] = d[2] = 0.0
        return p, d

    def into(self, p: np.ndarray) -> np.ndarray:
        s = np.clip((p[1:5] - self.low) / (self.high - self.low), 1e-6, 1 - 1e-6)
        return np.concatenate([[math.log(max(p[0] - FLOOR, 1e-12) / self.scale)], np.log(s / (1 - s)), p[5:] / self.scale])


def _bfgs(f, z: np.ndarray, rounds: int, tolerance: float) -> tuple[np.ndarray, float, bool]:
    """Quasi-Newton descent with backtracking; f gives value and gradient."""
    value, g = f(z)
    h = np.eye(len(z)) / max(1.0, float(np.abs(g).max()))
    for _ in range(rounds):
        if np.abs(g).max() < tolerance * max(1.0, abs(value)):
            return z, value, True
        step = -h @ g
        slope = float(step @ g)
        if slope >= 0:
            h = np.eye(len(z)) / max(1.0, float(np.abs(g).max()))
            step = -h @ g
            slope = float(step @ g)
        step *= min(1.0, 4.0 / max(float(np.abs(step).max()), 1e-12))
        slope, size = float(step @ g), 1.0
        while size > 1e-10:
            new, new_g = f(z + size * step)
            if new <= value + 1e-4 * size * slope:
                break
            size *= 0.5 if size > 0.2 else 0.2
        else:
            return z, value, True
        s, y = size * step, new_g - g
        gained = value - new
        z, value, g = z + s, new, new_g
        sy = float(s @ y)
        if sy > 1e-12:
            rho = 1 / sy
            a = np.eye(len(z)) - rho * np.outer(s, y)
            h = a @ h @ a.T + rho * np.outer(s, s)
        if gained < 1e-10 * max(1.0, abs(value)):
            return z, value, True
    return z, value, False


def _start(data: Data, core: np.ndarray, exog: np.ndarray) -> np.ndarray:
    """Omega scaled by the variance, no gamma where it is not fitted, beta lowered until the start is stationary."""
    p = np.concatenate([core * np.array([data.var0, 1, float(data.leverage), 1, 1]), exog])
    rest = p[1] + abs(p[2]) / 2
    if rest + p[3] >= data.stationary:
        p[3] = labels.START_REPAIR - rest
    return p


def default_start(data: Data) -> np.ndarray:
    return _start(data, np.array([labels.DEFAULT_START[n] for n in NAMES]), np.zeros(data.exog.shape[1]))


def random_starts(data: Data, n: int, seed: int | None) -> list[np.ndarray]:
    """The default start and n - 1 random ones."""
    rng = np.random.default_rng(seed)
    low, high = np.array([labels.START_RANGES[k] for k in NAMES]).T
    return [default_start(data)] + [_start(data, rng.uniform(low, high), rng.normal(0.0, labels.START_EXOG_SD, data.exog.shape[1])) for _ in range(n - 1)]


def fit(data: Data, start: np.ndarray | None = None, rounds: int = 200) -> Fit:
    """Maximum likelihood under the bounds and alpha + beta + |gamma|/2 <= stationary, by augmented Lagrangian steps."""
    space = _Space(data)
    z = space.into(default_start(data) if start is None else np.asarray(start, float))
    signs = (1.0, -1.0) if data.leverage else (1.0,)
    load, mu, ok = np.zeros(len(signs)), 1e3, False

    def target(x: np.ndarray) -> tuple[float, np.ndarray]:
        p, d = space.out(x)
        value, g = gradient(data, p)
        g = g.copy()
        for k, sign in enumerate(signs):
            over = load[k] - mu * (data.stationary - p[1] - p[3] - sign * p[2] / 2)
            if over > 0:
                value += over * over / (2 * mu)
                g[1] += over
                g[3] += over
                g[2] += sign * over / 2
        return value, g * d

    for _ in range(6):
        z, _, ok = _bfgs(target, z, rounds, 1e-7)
        p, _ = space.out(z)
        slack = np.array([data.stationary - p[1] - p[3] - s * p[2] / 2 for s in signs])
        load = np.maximum(0, load - mu * slack)
        if slack.min() > -1e-7:
            break
        mu *= 4
    p, _ = space.out(z)
    excess = p[1] + p[3] + abs(p[2]) / 2 - data.stationary
    if excess > 0:
        p[3] = max(FLOOR, p[3] - excess)
    value = negative_loglik(data, p)
    return Fit(p, value, bool(ok and value < 1e6 and excess < 1e-3), 1, int(ok))


def fit_multistart(data: Data, n: int = 5, seed: int | None = None, rounds: int = 200) -> Fit:
    """The best converged fit of all starts; the best of any if none converged."""
    fits = [fit(data, s, rounds) for s in random_starts(data, n, seed)]
    good = [f for f in fits if f.ok]
    best = min(good or fits, key=lambda f: f.negll)
    return Fit(best.params, best.negll, bool(good), n, len(good))


def hessian(data: Data, p: np.ndarray, h: float = 1e-5) -> np.ndarray:
    """Second derivatives: central differences of the analytic gradient, with steps relative to the parameter."""
    out = np.zeros((len(p), len(p)))
    for k in range(len(p)):
        e = np.zeros(len(p))
        e[k] = h * max(1e-2, abs(p[k]))
        out[k] = (gradient(data, p + e)[1] - gradient(data, p - e)[1]) / (2 * e[k])
    return (out + out.T) / 2


def std_errors(data: Data, p: np.ndarray, only: list[int] | None = None) -> np.ndarray:
    """Square roots of the inverse Hessian's diagonal (of a sub-block with ``only``), NaN where it is not positive."""
    free = only if only is not None else [k for k in range(len(p)) if data.leverage or k != 2]
    block = hessian(data, p)[np.ix_(free, free)]
    out = np.full(len(p), np.nan)
    try:
        diagonal = np.diag(np.linalg.inv(block))
    except np.linalg.LinAlgError:
        return out
    out[free] = np.sqrt(np.where(diagonal > 0, diagonal, np.nan))
    return out


def p_values(p: np.ndarray, se: np.ndarray, n: int, k: int) -> np.ndarray:
    with np.errstate(all="ignore"):
        t = p / se
    return np.where(np.isfinite(t), t_sf2(np.where(np.isfinite(t), t, 0), max(n - k, 1)), np.nan)


def criteria(negll: float, n: int, model: str, n_exog: int) -> tuple[int, float, float]:
    """(parameters counted, AIC, BIC); the profiled mean counts as one: 5, 6 or 6 plus the exogenous terms."""
    k = {"GARCH": 5, "GJR": 6}.get(model, 6 + n_exog)
    return k, 2 * negll + 2 * k, 2 * negll + k * math.log(n)


def garch11(returns: np.ndarray) -> Fit | None:
    """GARCH(1,1) with its own bounds (beta < 0.98, alpha + beta <= 0.998); None below 100 observations."""
    if len(returns) < 100:
        return None
    data = Data(returns, np.zeros((len(returns), 0)), leverage=False, max_beta=0.98, stationary=0.998)
    start = np.array([data.var0 * 0.05, 0.06, 0.0, 0.92, 5.0])
    return fit(data, start)


def simulate(rng: np.random.Generator, p: np.ndarray, exog: np.ndarray, var0: float, mean: float = 0.0, z: np.ndarray | None = None, ceiling: float = 1e10):
    """(returns, variances, times on the floor, exploded) of a path whose variance is generated step by step."""
    n = len(exog)
    nu = p[4]
    if z is None:
        z = rng.standard_t(nu, n) * math.sqrt((nu - 2) / nu)
    push = exog @ p[5:] if exog.shape[1] else np.zeros(n)
    out, path, floor, now = np.empty(n), np.empty(n), 0, var0
    for t in range(n):
        if t:
            e = out[t - 1]
            now = p[0] + (p[1] + (p[2] if e < 0 else 0.0)) * e * e + p[3] * now + push[t]
            if now < FLOOR:
                now, floor = FLOOR, floor + 1
            if not now < ceiling:
                return out, path, floor, True
        path[t] = now
        out[t] = z[t] * math.sqrt(now)
    return mean + out, path, floor, False


def t_loglik_check(z: np.ndarray, nu: float) -> float:
    """Log-likelihood of unit-variance Student-t draws, for tests."""
    c = float(lgamma((nu + 1) / 2) - lgamma(nu / 2)) - 0.5 * math.log(math.pi * (nu - 2))
    return float((c - (nu + 1) / 2 * np.log1p(z * z / (nu - 2))).sum())
