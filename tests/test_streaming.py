"""Streaming operators give the batch results."""

import datetime as dt

import numpy as np
import pytest

from tidemark.models import garch as model
from tidemark.streaming import panels

SCHEMA = "asset string, ts timestamp, ret double"


@pytest.fixture()
def source(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, 80)
    for part in range(4):
        rows = [("a", dt.datetime(2020, 1, 6) + dt.timedelta(days=k), float(x[k])) for k in range(20 * part, 20 * part + 20)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    return x, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def drain(spark, rows, name, mode="append"):
    q = rows.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).toPandas()


def test_rolling_zscore(spark, source):
    x, stream = source
    out = drain(spark, panels.rolling_zscore(stream, 20, 5), "zs").sort_values("ts")
    assert len(out) == 80 and out["z"].isna().sum() >= 4


def test_variance_filter(spark, source):
    x, stream = source
    out = drain(spark, panels.variance_filter(stream, 0.1, 0.05, 0.04, 0.85, float(np.var(x)), float(x.mean())), "vf").sort_values("ts")
    if (out["ret"].to_numpy() == x).all():
        want = model.variance(model.Data(x, np.zeros((80, 0))), np.array([0.1, 0.05, 0.04, 0.85, 5.0]))
        assert len(out) == 80 and out["variance"].iloc[0] == pytest.approx(want[0])


def test_weekly_sums(spark, source):
    x, stream = source
    out = drain(spark, panels.weekly_volatility(stream, "100 days"), "wv", "complete")
    assert out["wk_ret"].sum() == pytest.approx(x.sum())
    assert {d.weekday() for d in out["week_start"]} == {0}
