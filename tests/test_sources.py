"""Readers and sinks on literal files."""

import datetime as dt

import pytest

from tidemark.sources import readers, sinks


def test_prices(spark, tmp_path):
    (tmp_path / "a.csv").write_text("snapped_at,price,extra\n2019-01-02 00:00:00 UTC,2.5,x\n2019-01-01 00:00:00 UTC,1.5,\n2019-01-02 00:00:00 UTC,9.5,y\n2019-01-03 00:00:00 UTC,,\n")
    rows = readers.read_prices(spark, {"a": f"file://{tmp_path}/a.csv"})
    assert rows.count() == 4 and rows.where("price is null").count() == 1
    first = readers.first_of_day(rows, ["snapped_at", "price"]).orderBy("date").collect()
    assert [(r["date"], r["price"]) for r in first][:2] == [(dt.date(2019, 1, 1), 1.5), (dt.date(2019, 1, 2), 2.5)]


def test_missing_column(spark, tmp_path):
    (tmp_path / "b.csv").write_text("snapped_at,close\n2019-01-01,1\n")
    with pytest.raises(readers.MissingColumns):
        readers.read_prices(spark, {"b": f"file://{tmp_path}/b.csv"})


def test_events_with_commas_and_marks(spark, tmp_path):
    (tmp_path / "e.csv").write_text('event_id,date,label,title,type\n1,2019-01-31,x,"One, two – three",Infrastructure\n2,2019-02-01,y,"He said ""no""",Regulatory\n')
    rows = readers.read_events(spark, f"file://{tmp_path}/e.csv").orderBy("event_id").collect()
    assert rows[0]["title"] == "One, two – three" and rows[1]["title"] == 'He said "no"' and rows[0]["date"] == dt.date(2019, 1, 31)


def test_sentiment(spark, tmp_path):
    (tmp_path / "s.csv").write_text("week_start,S_gdelt_raw,S_gdelt_normalized,total_articles,reg_proportion,infra_proportion\n2018-12-31 00:00:00.000000 UTC,-1.5,,10,0.5,0.25\n")
    row = readers.read_sentiment(spark, f"file://{tmp_path}/s.csv").first()
    assert row["week_start"] == dt.date(2018, 12, 31) and row["S_gdelt_normalized"] is None and row["reg_proportion"] == 0.5


def test_json_defaults(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"events": [{"event_id": 1, "date": "2020-01-01", "type": "A", "meets_impact_threshold": true}, {"event_id": 2, "date": "2020-01-02", "type": "A", "type_detailed": "B", "meets_impact_threshold": true},\n{"event_id": 3, "type": "A"}, {"event_id": 4, "type": "A", "meets_impact_threshold": true, "include_in_reanalysis": false}]}')
    rows = readers.read_reclassified(spark, f"file://{tmp_path}/r.json").orderBy("event_id").collect()
    assert [(r["event_id"], r["type"]) for r in rows] == [(1, "A"), (2, "B")]


def test_latest_cache(spark, tmp_path):
    for name, value in (("a_2020", 1.0), ("a_2021", 2.0)):
        spark.createDataFrame([(dt.datetime(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, value, "A")], readers.OHLCV).coalesce(1).write.parquet(f"file://{tmp_path}/cache/{name}")
    rows = readers.read_latest_cache(spark, f"file://{tmp_path}/cache/*").collect()
    assert [(r["asset"], r["ret"]) for r in rows] == [("A", 2.0)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.1 + 0.2), (2, None)], "k int, v double")
    out = sinks.publish(rows, f"file://{tmp_path}/draws")
    assert sinks.checksum(out) == sinks.checksum(rows)
    sinks.publish(rows.where("k = 1"), f"file://{tmp_path}/draws")
    assert spark.read.parquet(f"file://{tmp_path}/draws").count() == 1
    sinks.write_csv(rows.where("k = 1"), f"file://{tmp_path}/csv", digits=17)
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True, schema="k int, v double").first()["v"] == 0.1 + 0.2
    a, b = (sinks.run_record(spark, "x", {"seed": 1}, {"t": t}).first()["inputs"] for t in (rows, rows.repartition(3)))
    assert a == b


def test_sections(spark, tmp_path):
    a = spark.createDataFrame([("x, y", 0.1 + 0.2), ("z", None)], "name string, v double")
    b = spark.createDataFrame([(1, True)], "k int, ok boolean")
    sinks.write_sections({"first table": a, "second": b}, f"file://{tmp_path}/s")
    back = readers.read_sections(spark, f"file://{tmp_path}/s/*.txt", {"first table": "name string, v double", "second": "k int, ok boolean"})
    assert sorted(map(str, back["first table"].collect())) == sorted(map(str, a.collect())) and back["second"].collect() == b.collect()
    text = next((tmp_path / "s").glob("*.txt")).read_text()
    assert text.startswith("# first table\nname,v\n") and "# second\nk,ok\n1,true\n" in text


def test_archive(spark, tmp_path):
    import numpy as np

    draws = {"dbar": np.array([0.1, np.nan, -0.0, np.inf]), "used": np.array([True, False, True, True]), "gaps": np.arange(6.0).reshape(2, 3), "none": np.zeros(0)}
    for path in (f"file://{tmp_path}/draws",) * 2:
        sinks.write_archive(spark, path, draws, {"seed": "42", "law": "t copula"})
        arrays, notes = sinks.read_archive(spark, path)
    assert notes == {"seed": "42", "law": "t copula"} and {k: (v.dtype, v.shape, v.tobytes()) for k, v in arrays.items()} == {k: (v.dtype, v.shape, v.tobytes()) for k, v in draws.items()}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(sinks, "read_archive", lambda *_: ({}, {}))
        with pytest.raises(sinks.ReadBackError):
            sinks.write_archive(spark, f"file://{tmp_path}/draws", draws)


def test_pages():
    from tidemark.sources import paged

    table, asked = [(t, 1.0, 2.0, 0.5, 1.5, float(t)) for t in range(0, 2500)], []

    def fetch(endpoint, symbol, start, limit):
        asked.append((endpoint, start))
        if endpoint == "down":
            raise OSError("refused")
        return [r for r in table if r[0] >= start][:limit]

    got = [r for page in paged.pages(fetch, ["down", "up"], "A", 3, 2400) for r in page]
    assert got == table[3:2400] and [s for e, s in asked if e == "up"] == [3, 1003, 2003]
    assert paged.fingerprint(got) == paged.fingerprint(got[::-1]) != paged.fingerprint(got[1:])
    with pytest.raises(paged.NoEndpoint, match="refused"):
        list(paged.pages(fetch, ["down"], "A", 0, 10))
    assert list(paged.pages(fetch, ["up"], "A", 5000, 6000)) == []


def test_quotes(spark):
    from tidemark.sources import paged

    def fetch(endpoint, symbol, start, limit):
        return [(t, 1.0, 2.0, 0.5, 1.5, 9.0) for t in range(start, 1300)][:limit] if symbol != "none" else []

    rows = paged.read_quotes(spark, fetch, ["one"], ["a", "b", "none"], 0, 1200)
    assert {r["symbol"]: r["count"] for r in rows.groupBy("symbol").count().collect()} == {"a": 1200, "b": 1200}
