"""Every query with a SQL twin gives the twin's rows on the smallest tables; the others give rows."""

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tidemark.plans import QUERIES, SQL, models

DATA = os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
#: Draws of simulated queries here; a plain number of rows and shares of used draws are asserted below.
DRAWS = 12


def canonical(pdf):
    out = []
    for row in pdf[sorted(pdf.columns)].itertuples(index=False):
        out.append(tuple(None if v is None or v != v else v.isoformat()[:10] if hasattr(v, "isoformat") else bool(v) if str(type(v)).find("bool") >= 0 else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v) for v in row))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = canonical(ours), canonical(theirs)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=2e-6, rel=1e-9) if all(isinstance(v, float) for v in x + y) else x == y


@pytest.fixture(autouse=True)
def few_draws(monkeypatch):
    for name, n in (("DRAWS", DRAWS), ("PANELS", DRAWS), ("LAW", DRAWS)):
        monkeypatch.setattr(models, name, n)


#: Rows of queries without a twin: a number, or the least number.
ROWS = {"b6_gaussian_null": 1, "b7_free_draws": 1, "b8_wild": 1, "b9_student_copula": 1, "b10_matched_gaussian_copula": 1, "b10_student_free": 2, "b11_recursive_null": 1, "b12_rescued_refits": 1, "b13_size_study": 8, "b14_perturbed_process": 40, "b15_copula_df_grid": 3, "b16_asset_gaps": 36, "b1_bca_interval": 2, "b2_block_bootstrap": 1, "b3_pooled_bootstrap": 1, "b5_did_bootstrap": 1, "e9_gate": 2, "f3_gjr_garch_x": 6, "f7_garch11": 6, "f11_model_ladder": 18, "f12_diagnostics": 6, "f17_break_controls": 18, "f17_specification_sweep": 4, "f17_pre_window_sweep": 4, "f17_winsoriser_sweep": 10, "f17_mean_equation": 2, "g13_heatmap_order": 6, "k13_arch_lm": 6, "k16_granger_weekly": 36, "k16_granger_daily": 36, "k17_conditional_granger": 18, "k18_granger_given_events": 18, "k19_toda_yamamoto": 18, "k20_stationarity": 6, "k21_missingness": 6, "k22_sub_periods": 108, "v2_array_hash": 6}
#: Numbers that may be null: of fits or tests that the short series do not allow.
MAY_BE_NULL = {"f17_break_controls", "k17_conditional_granger", "k18_granger_given_events", "k22_sub_periods", "k21_missingness", "e5_cross_sectional", "f3_gjr_garch_x", "f11_model_ladder", "e9_gate"}
WIDE = os.environ.get("TIDEMARK_TESTDATA_WIDE", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    longer = name[0] == "b" or name in ("e5_cross_sectional", "e9_gate", "k1_student_t_quantile")  # the smallest series are short
    rows = QUERIES[name](spark, WIDE if longer and os.path.isdir(WIDE) else DATA).toPandas()
    assert len(rows) == ROWS.get(name, len(rows)) and len(rows) > 0
    numbers = rows.select_dtypes("number")
    assert np.isfinite(numbers.to_numpy(float, na_value=0.0)).all()
    if name not in MAY_BE_NULL:
        assert not numbers.isna().any().any()
    for c in (c for c in rows.columns if c == "p" or c.startswith("p_") and rows[c].dtype == float or c.endswith("_p")):
        assert rows[c].dropna().between(0, 1).all()
    if "share_dropped" in rows:
        assert (rows.share_dropped < 0.1).all() and (rows.n_used >= 0.9 * DRAWS).all()
    if "n_dropped" in rows:
        assert (rows.n_dropped <= 1).all() and (rows.ci_low < rows.ci_high).all()
    if name == "b12_rescued_refits":
        assert rows.n[0] == DRAWS and rows.excluded[0] <= 1
    if name in ("b13_size_study", "b14_perturbed_process"):
        # Under tails of 2.5 degrees some panels have event terms beyond the bound and are left out.
        assert rows["size"].between(0, 1).all() and (rows.n >= DRAWS // 4).all() and set(rows.alpha) == {0.05, 0.1}
    if name == "b16_asset_gaps":
        assert rows["corr"].between(-1 - 1e-9, 1 + 1e-9).all() and (rows[rows.a == rows.b]["corr"] > 0.999).all()


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["event_id", "type", "mean_car", "n_assets"]
    assert rows.count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
