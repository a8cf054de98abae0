"""Joint innovations across assets on a shared calendar: Gaussian, Student-t copula, common signs."""

from __future__ import annotations

import numpy as np

from tidemark.functions.special import norm_cdf, t_cdf, t_ppf


def positive_root(r: np.ndarray) -> tuple[np.ndarray, float]:
    """(Cholesky factor, jitter): the jitter grows tenfold from 1e-8 until the matrix is positive definite."""
    jitter = 0.0
    for k in range(-1, 12):
        jitter = 0.0 if k < 0 else 1e-8 * 10**k
        try:
            return np.linalg.cholesky(r + jitter * np.eye(len(r))), jitter
        except np.linalg.LinAlgError:
            continue
    raise np.linalg.LinAlgError("no jitter makes the matrix positive definite")


def gaussian(rng: np.random.Generator, root: np.ndarray, n: int) -> np.ndarray:
    return rng.standard_normal((n, len(root))) @ root.T


def student(rng: np.random.Generator, root: np.ndarray, nu: np.ndarray, nu_copula: float | None, n: int) -> np.ndarray:
    """Unit-variance Student-t margins with a t copula of ``nu_copula`` (None: Gaussian copula)."""
    z = gaussian(rng, root, n)
    if nu_copula is None:
        u = norm_cdf(z)
    else:
        u = t_cdf(z / np.sqrt(rng.chisquare(nu_copula, size=(n, 1)) / nu_copula), nu_copula)
    u = np.clip(u, 1e-12, 1 - 1e-12)
    return np.column_stack([t_ppf(u[:, j], v) * np.sqrt((v - 2) / v) for j, v in enumerate(nu)])


def signs(rng: np.random.Generator, n: int) -> np.ndarray:
    """One sign for each day, common to all assets."""
    return rng.choice([-1.0, 1.0], n)
