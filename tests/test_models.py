"""Numeric kernel and models: closed forms, derivatives, recovery of simulated parameters."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import special
from tidemark.models import breaks, copula, garch, ordering, regression, resampling

TRUE = np.array([0.05, 0.06, 0.04, 0.88, 6.0, 0.5, 0.2])


def simulated(n=2000, seed=1, p=TRUE):
    rng = np.random.default_rng(seed)
    x = (rng.random((n, len(p) - 5)) < 0.05).astype(float)
    r, v, _, _ = garch.simulate(rng, p, x, 2.0)
    return r, x, v


def test_t_closed_forms():
    t = np.array([0.1, 1.0, 5.0])
    assert special.t_sf2(t, 1) == pytest.approx(1 - 2 / np.pi * np.arctan(t), abs=1e-12)
    assert special.t_sf2(t, 2) == pytest.approx(1 - t / np.sqrt(2 + t * t), abs=1e-12)
    assert special.t_sf2(1.96, 1e7) == pytest.approx(2 * (1 - NormalDist().cdf(1.96)), abs=1e-6)


def test_other_tails():
    assert special.chi2_sf(4.0, 2) == pytest.approx(math.exp(-2), rel=1e-12)
    assert float(special.f_sf(2.5**2, 1, 9)) == pytest.approx(float(special.t_sf2(2.5, 9)), rel=1e-10)
    assert special.chi2_sf(3.84145882, 1) == pytest.approx(0.05, abs=1e-8)


@given(st.floats(1e-9, 1 - 1e-9), st.floats(2.1, 60))
@settings(max_examples=60, deadline=None)
def test_t_quantile_inverts(p, df):
    assert float(special.t_cdf(special.t_ppf(np.array([p]), df), df)[0]) == pytest.approx(p, rel=1e-6)


def test_recursion_is_a_loop():
    r, x, _ = simulated(300)
    d = garch.Data(r, x)
    v = [d.var0]
    for t in range(1, 300):
        e = d.resid[t - 1]
        v.append(max(TRUE[0] + (TRUE[1] + (TRUE[2] if e < 0 else 0)) * e * e + TRUE[3] * v[-1] + x[t] @ TRUE[5:], 1e-8))
    assert garch.variance(d, TRUE) == pytest.approx(np.array(v), rel=1e-10)


def test_floor_is_kept():
    r, x, _ = simulated(200)
    p = TRUE.copy()
    p[5] = -40.0
    assert garch.variance(garch.Data(r, x), p).min() == garch.FLOOR


def test_gradient():
    r, x, _ = simulated(500)
    d, p = garch.Data(r, x), TRUE * 1.1
    numeric = [(garch.negative_loglik(d, p + e) - garch.negative_loglik(d, p - e)) / 2e-6 for e in np.eye(len(p)) * 1e-6]
    assert garch.gradient(d, p)[1] == pytest.approx(np.array(numeric), rel=1e-3, abs=1e-3)


def test_fit_beats_truth_and_starts():
    r, x, _ = simulated()
    d = garch.Data(r, x)
    f = garch.fit_multistart(d, 4, 0)
    assert f.ok and f.negll <= garch.negative_loglik(d, TRUE)
    assert all(f.negll <= garch.negative_loglik(d, s) for s in garch.random_starts(d, 4, 0))
    assert f.persistence <= garch.STATIONARY + 1e-6
    se = garch.std_errors(d, f.params)
    assert np.all(np.abs(f.params - TRUE)[1:4] < 5 * se[1:4])


def test_boundary_fit_stays_stationary():
    rng = np.random.default_rng(3)
    r, _, _, _ = garch.simulate(rng, np.array([0.02, 0.1, 0.0, 0.8999, 4.0]), np.zeros((1500, 0)), 1.0)
    f = garch.fit_multistart(garch.Data(r, np.zeros((1500, 0))), 3, 0)
    assert f.ok and f.persistence <= garch.STATIONARY + 1e-6


def test_no_leverage_and_garch11():
    r, _, _ = simulated()
    assert garch.fit(garch.Data(r, np.zeros((len(r), 0)), leverage=False)).params[2] == 0
    assert garch.garch11(r[:99]) is None
    f = garch.garch11(r)
    assert f.params[1] + f.params[3] <= 0.998 + 1e-6


def test_criteria_count_the_mean():
    assert [garch.criteria(1.0, 100, m, 5)[0] for m in ("GARCH", "GJR", "GJRX")] == [5, 6, 11]


def test_breaks_found_and_not_invented():
    rng = np.random.default_rng(0)
    y = np.concatenate([rng.normal(0, 1, 200), rng.normal(4, 1, 200), rng.normal(-3, 1, 200)])
    found = breaks.detect(y)
    assert len(found) == 2 and abs(found[0] - 200) <= 2 and abs(found[1] - 400) <= 2
    assert len(breaks.detect(rng.normal(0, 1, 400))) <= 1  # BIC alone is lenient
    assert breaks.detect(y[:99]) == []
    low, high = breaks.interval(y[:400], 200)
    assert low <= 200 <= high


def test_optimal_segmentation_is_exhaustive():
    rng = np.random.default_rng(2)
    y = rng.normal(size=24)
    cost = lambda a, b: ((y[a:b] - y[a:b].mean()) ** 2).sum()
    best = min(cost(0, i) + cost(i, j) + cost(j, 24) for i in range(4, 24) for j in range(i + 4, 21))
    assert breaks.optimal_segmentations(y, 2, 4)[2][0] == pytest.approx(best)


def test_granger_direction():
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    y = np.concatenate([[0], 0.8 * x[:-1]]) + rng.normal(size=400)
    assert regression.granger(y, x, 4, 40)["p"] < 1e-6 < regression.granger(x, y, 4, 40)["p"]
    assert regression.granger(y[:30], x[:30], 4, 40) is None
    assert regression.conditional_granger(y, x, [rng.normal(size=400)], 4)["p"] < 1e-6
    assert regression.toda_yamamoto(y, x, 4)["p"] < 1e-6


def test_unit_roots():
    rng = np.random.default_rng(7)
    e = rng.normal(size=500)
    walk = np.cumsum(e)
    assert regression.adf(e)[1] < 0.01 and regression.adf(walk)[1] > 0.05
    assert regression.kpss(e)[1] >= 0.05 and regression.kpss(walk)[1] <= 0.05


def test_arch_effect_and_logit():
    r, _, v = simulated()
    assert regression.arch_lm(r, 5)[1] < 0.01
    rng = np.random.default_rng(1)
    x = rng.normal(size=2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(0.3 + 0.9 * x)))).astype(float)
    slope, p = regression.logit(y, x)
    assert slope == pytest.approx(0.9, abs=0.15) and p < 1e-10


def test_resampling():
    rng = np.random.default_rng(0)
    a, b = rng.normal(1, 1, 40), rng.normal(0, 1, 40)
    one, two = resampling.difference(a, b, 500, 3), resampling.difference(a, b, 500, 3)
    assert one == two and one["ci_low"] < one["diff"] < one["ci_high"] and 0 <= one["p_two"] <= 1
    out = resampling.bca(a, 500)
    assert out["ci_low"] < out["statistic"] < out["ci_high"]
    # Without bias and skewness the interval is that of the percentiles; a mean's acceleration is a sixth of its skewness.
    assert [resampling.bca_level(z, 0.0, 0.0) for z in (-1.959963984540054, 1.959963984540054)] == pytest.approx([0.025, 0.975])
    x = rng.exponential(size=60)
    g = x - x.mean()
    assert resampling.bca(x, 50)["acceleration"] == pytest.approx((g**3).sum() / (6 * (g @ g) ** 1.5))
    assert resampling.bca(x, 4000)["ci_low"] > np.percentile(x[rng.integers(0, 60, (4000, 60))].mean(axis=1), 2.5), "skewed to the right"
    for f in (np.mean, np.sum, np.std):
        assert resampling._without_one(x, f) == pytest.approx(np.array([f(np.delete(x, k)) for k in range(60)]))
    assert resampling.bca(np.ones(5), 20)["ci_low"] == 1.0


def test_difference_draws_as_choice_does():
    rng, a, b = np.random.default_rng(3), np.arange(5.0), np.arange(7.0) ** 2
    want = [rng.choice(a, 5).mean() - rng.choice(b, 7).mean() for _ in range(40)]
    assert resampling.difference(a, b, 40, 3)["se"] == pytest.approx(np.std(want))


def test_copula_margins():
    rng = np.random.default_rng(0)
    root, jitter = copula.positive_root(np.array([[1, 0.6], [0.6, 1]]))
    z = copula.student(rng, root, np.array([5.0, 8.0]), 6.0, 40_000)
    assert jitter == 0 and z.var(axis=0) == pytest.approx(np.ones(2), abs=0.08)
    assert np.corrcoef(z.T)[0, 1] == pytest.approx(0.6, abs=0.06)
    assert copula.positive_root(np.ones((3, 3)))[1] > 0


def test_linkage_keeps_neighbours():
    d = np.array([[0, 9, 1, 9], [9, 0, 9, 1], [1, 9, 0, 9], [9, 1, 9, 0]], float)
    order = ordering.linkage_order(d)
    assert abs(order.index(0) - order.index(2)) == 1 and abs(order.index(1) - order.index(3)) == 1
