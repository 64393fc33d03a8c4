"""Time parsing, ingest, archives, plans, documents, streaming, isolation."""

import json
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.errors import SchemaError
from sensorloom.functions import timebase
from sensorloom.functions.quality import annotate
from sensorloom.operators import baselines, isolation
from sensorloom.plans import documents, runner
from sensorloom.sources import archives, fixtures
from sensorloom.streaming import screens


def test_windows():
    a, b = timebase.parse_window("2024-01-01/PT90M")
    assert b - a == timedelta(minutes=90)
    assert timebase.parse_window("2024-01-01") == timebase.parse_window("P1D/2024-01-02")
    for bad in ("2024-01-01T00:00/PT1H", "2024-01-02/2024-01-01", "P1M/2024-01-01", "2024-01-01T00:00Z"):
        with pytest.raises(ValueError):
            timebase.parse_window(bad)
    with pytest.raises(ValueError):
        timebase.parse_periods("2024-01-01/2024-01-03", "2024-01-02/2024-01-04")
    got = timebase.dst_transitions(datetime(2024, 3, 30, tzinfo=UTC), datetime(2024, 4, 1, tzinfo=UTC), "Europe/London")
    assert [abs((g - datetime(2024, 3, 31, 1, tzinfo=UTC)).total_seconds()) <= 1 for g in got] == [True]


def test_localise(spark):
    local = ["2024-10-27 00:30:00", "2024-10-27 01:30:00", "2024-10-27 01:10:00", "2024-10-27 02:30:00"]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(local)] + [("b", 0, "2024-03-31 01:30:00")], "point_id string, row_ix long, local string")
    rows, refused = timebase.localise(df, "local", "Europe/London", ["point_id"])
    got = [r["ts"].strftime("%H:%M") for r in rows.where("point_id = 'a'").orderBy("row_ix").collect()]
    assert got == ["23:30", "00:30", "01:10", "02:30"]
    assert [r["tags"] for r in refused.collect()] == ["b"]


def test_date_order(spark):
    df = lambda *s: spark.createDataFrame([(x,) for x in s], "s string")
    assert timebase.date_order(df("13/02/2024", "25/02/2024"), "s") == "day"
    assert timebase.date_order(df("2024-01-02"), "s") == "iso"
    for bad in (("01/02/2024",), ("13/02/2024", "02/13/2024")):
        with pytest.raises(SchemaError):
            timebase.date_order(df(*bad), "s")
    r = df("13/02/2024 10:05", "14.2.24").select(timebase.parse_stamps(F.col("s"), "day").alias("t")).collect()
    assert [x["t"].strftime("%d%m%Y") for x in r] == ["13022024", "14022024"]


def test_ingest_and_store(spark, tmp_path):
    (tmp_path / "w.csv").write_text("time;A;A.q;B\n2024-01-01 00:00:00;1,5;GOOD;2\n2024-01-01 00:01:00;x;BAD;3\n")
    with pytest.raises(SchemaError):
        archives.read_csv(spark, str(tmp_path / "w.csv"))
    raw = archives.read_csv(spark, str(tmp_path / "w.csv"), sep=";", decimal=",")
    long = archives.from_wide(raw, "time", "s", ".q")
    got = archives.to_samples(long, timebase.parse_stamps(F.col("stamp"), "iso"), "GOOD")
    rows = {(r["point_id"], r["row_ix"] % 10): (r["value"], r["state"], r["quality"]) for r in got.collect()}
    assert rows == {("A", 0): (1.5, None, "GOOD"), ("A", 1): (None, "x", "BAD"), ("B", 0): (2.0, None, "GOOD"), ("B", 1): (3.0, None, "GOOD")}
    store = archives.Store(spark, str(tmp_path / "store"))
    demo = fixtures.demo(spark).withColumn("state", F.lit(None).cast("string"))
    store.write(demo, [fixtures.FLOW, fixtures.TEMPERATURE])
    assert [r["point_id"] for r in store.list_tags().collect()] == ["FIC101.PV", "TIC101.PV"]
    assert store.samples().count() == 1124 and store.window(fixtures.T0, fixtures.T0, ["FIC101.PV"]).count() == 1
    with pytest.raises(Exception):
        store.write(demo, [fixtures.FLOW])
    plan = 'window = "2024-03-31T01:00Z/2024-03-31T06:00Z"\nbaseline = "2024-03-30T20:00Z/2024-03-31T01:00Z"\nsteps = ["spc", "profile", "screen"]\n'
    book = json.loads(runner.run(store.samples(), plan))
    flow = [r for r in book["findings"]["screen"] if r["point_id"] == "FIC101.PV"]
    assert len(flow) == 29 and book["result_kind"] == "run" and list(book["findings"]) == ["profile", "screen", "spc"]
    with pytest.raises(ValueError):
        runner.load_plan('window = "2024-01-01"\nsteps = ["screen"]')
    assert "<table>" in documents.html_report("t", {"a": flow}) and documents.text_table([]) == "(no rows)"


def test_streams(spark, tmp_path):
    demo = fixtures.demo(spark)
    demo.coalesce(1).write.parquet(str(tmp_path / "in"))
    base = baselines.mad_baseline(annotate(demo).where("valid").where(F.col("ts") < F.lit(datetime(2024, 3, 31, 1, tzinfo=UTC))))
    stream = spark.readStream.schema(demo.schema).parquet(str(tmp_path / "in"))
    q = screens.screen_stream(stream, base).writeStream.format("memory").queryName("flags").trigger(availableNow=True).start()
    q.awaitTermination()
    want = baselines.screen(annotate(demo).where("valid"), base).where("flagged").count()
    assert spark.table("flags").count() == want
    q = screens.windowed_severity(stream).writeStream.format("memory").queryName("sev").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sev").columns == ["source_id", "point_id", "start", "n_good", "n_uncertain", "n_bad"]


def test_isolation_draws_from_all_rows(spark):
    # a third of over 200,000 rows are equal: every tree's sample has about that share of them
    df = spark.range(210_000).selectExpr("CASE WHEN id % 3 = 0 THEN -1D ELSE id * 1D END AS a", "CASE WHEN id % 3 = 0 THEN 0D ELSE id % 7 * 1D END AS b")
    got = isolation.samples(df, ["a", "b"], trees=5).toPandas()
    assert (got.groupby("tree").size() == 256).all() and got[got.a >= 0].groupby("tree").a.nunique().equals(got[got.a >= 0].groupby("tree").size().rename("a"))
    assert (got.a.eq(-1).groupby(got.tree).mean().between(0.22, 0.45)).all()
    again = isolation.samples(df.repartition(7), ["a", "b"], trees=5).toPandas()
    key = ["tree", "u", "a", "b"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    few = isolation.fit(df.limit(10), ["a", "b"])
    assert few[1] == 10 and len(few[0]) == isolation.TREES


def test_isolation(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    x[:8] += 6
    m = isolation.train(x)
    assert isolation.score(m, x)[:8].min() > np.quantile(isolation.score(m, x)[8:], 0.9)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:20]] + [(None, 1.0, 1.0)], "a double, b double, c double")
    got = isolation.score_rows(df, ["a", "b", "c"], m).collect()
    assert sum(r["score"] is None for r in got) == 1


def test_offset_changes_to_the_second():
    from sensorloom.functions import timebase

    at = timebase.dst_transitions(datetime(2024, 1, 1, tzinfo=UTC), datetime(2025, 1, 1, tzinfo=UTC), "Europe/Berlin")
    assert at == [datetime(2024, 3, 31, 1, tzinfo=UTC), datetime(2024, 10, 27, 1, tzinfo=UTC)]
    assert timebase.dst_transitions(at[0], at[1], "Europe/Berlin") == at[1:] and timebase.dst_transitions(at[0] , at[0], "UTC") == []
    assert len(timebase.dst_transitions(datetime(2024, 4, 1, tzinfo=UTC), datetime(2024, 4, 30, tzinfo=UTC), "Australia/Lord_Howe")) == 1


def test_archive_checks(spark, tmp_path):
    from sensorloom.contract import TagMeta
    from sensorloom.errors import SchemaError
    from sensorloom.sources import archives

    assert archives.safe_filename('a/b:c*"') == "a_b_c__" and archives.safe_filename("..") == "_"
    metas = {p: TagMeta("s", p, p) for p in ("a/b", "a:b", "ok")}
    assert archives.check_targets("/x", ["ok"], metas) == {"ok": "/x/s/ok.parquet"}
    for points, there in ((["a/b", "a:b"], False), (["nope"], False), (["ok"], True)):
        with pytest.raises(SchemaError):
            archives.check_targets("/x", points, metas, lambda path, there=there: there)
    (tmp_path / "x.parquet").write_text("no parquet")
    with pytest.raises(SchemaError):
        archives.read_schema(spark, str(tmp_path / "x.parquet"))
    one = str(tmp_path / "one")
    spark.createDataFrame([(datetime(2024, 1, 1 + i, tzinfo=UTC), float(i), "GOOD") for i in range(3)], "timestamp timestamp, value double, quality string").coalesce(1).write.parquet(one)
    tag = archives.SingleTag(spark, one, metas["ok"])
    assert [r["value"] for r in tag.window(datetime(2024, 1, 2, tzinfo=UTC), datetime(2024, 1, 3, tzinfo=UTC)).orderBy("row_ix").collect()] == [1.0, 2.0]


def test_ingest_checks_before_it_writes(spark, tmp_path):
    from sensorloom.contract import TagMeta
    from sensorloom.errors import SchemaError
    from sensorloom.sources import archives

    def rows(cells):
        return spark.createDataFrame([("s", p, i, t, v, q) for i, (p, t, v, q) in enumerate(cells)], "source_id string, point_id string, row_ix long, stamp string, raw string, quality string")

    stamp, metas = F.try_to_timestamp("stamp"), [TagMeta("s", "a", "A"), TagMeta("s", "b", "B")]
    good = [("b", "2024-01-01 00:00:00", "1", "GOOD"), ("a", "2024-01-01 00:00:00", "2", "good"), ("b", "2024-01-02 00:00:00", "3", "7")]
    store = archives.ingest(spark, rows(good), str(tmp_path / "good"), metas, stamp)
    assert store.samples().count() == 3 and store.extent().count() == 2
    codes = {r["point_id"]: r["codes"] for r in archives.quality_code_template(store.samples()).collect()}
    assert codes == {"a": {"good": "GOOD"}, "b": {"GOOD": "GOOD", "7": None}}
    for k, (cells, assumed) in enumerate([(good + [("c", "2024-01-01 00:00:00", "1", None)], None), (good, "GOOD"), (good + [("b", "2023-01-01 00:00:00", "1", "GOOD")], None), ([("a", "x", "1", "GOOD")], None), ([("a", "2024-01-01 00:00:00", "run", "GOOD")], None)]):
        with pytest.raises(SchemaError):
            archives.ingest(spark, rows(cells), str(tmp_path / f"bad{k}"), metas, stamp, assumed)
        assert not (tmp_path / f"bad{k}").exists()
    mixed = rows(good).select(stamp.alias("ts"), "point_id", "row_ix", "quality")
    assert archives.interleaved(rows([(p, f"2024-01-0{d} 00:00:00", "1", "GOOD") for d in (1, 2, 3) for p in "ab"]).withColumn("ts", stamp), ["quality", "point_id"]) == "point_id"
    assert archives.interleaved(mixed, ["quality"]) is None
