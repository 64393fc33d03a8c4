"""Queries over events whose stamps repeat, the rows of the table three times with keys of their own; rows of one tag in many tasks."""

import random
from datetime import UTC, datetime

import duckdb
import pytest
from pyspark.sql import functions as F
from test_catalog import SF, _plain

from sensorloom.functions import provenance
from sensorloom.operators import baselines, physics
from sensorloom.plans import catalog


@pytest.fixture(scope="module")
def thrice(tmp_path_factory):
    to = tmp_path_factory.mktemp("thrice")
    duckdb.sql(f"copy (select event_id + i * 1000000 as event_id, * exclude (event_id) from read_parquet('{SF}/events.parquet'), range(3) r(i) order by event_id) to '{to}/events.parquet' (format parquet)")
    return str(to)


def _same(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{sf}/events.parquet')")
    got, want = catalog.QUERIES[name](spark, sf), con.sql(catalog.ORACLES[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert _plain([[r[c] for c in cols] for r in got.collect()]) == _plain([[r[i] for i in at] for r in want.fetchall()])


@pytest.mark.parametrize("name", ["q_regime_screen", "q_regime_baselines", "q_regime_refusals"])
def test_regimes_at_repeated_stamps(spark, thrice, name):
    _same(spark, thrice, name)


def test_modes_at_repeated_stamps(spark):
    t = datetime(2024, 1, 1, tzinfo=UTC)
    values = spark.createDataFrame([("s", "p", 0, t, 1.0), ("s", "p", 1, t, 2.0)], "source_id string, point_id string, row_ix long, ts timestamp, value double")
    modes = spark.createDataFrame([("s", t, "A"), ("s", t, "A")], "source_id string, ts timestamp, state string")
    assert sorted((r["row_ix"], r["regime"]) for r in baselines.aligned_modes(values, modes).collect()) == [(0, "A"), (1, "A")]


def test_replay_diff_at_repeated_stamps(spark, thrice):
    _same(spark, thrice, "q_replay_diff")


def test_diff_of_repeated_stamps(spark):
    t = datetime(2024, 1, 1, tzinfo=UTC)
    rows = lambda *v: spark.createDataFrame([("s", at, x, "GOOD") for at, x in v], "k string, ts timestamp, value double, quality string")
    diff = lambda a, b: sorted(r["change"] for r in provenance.diff_frames(rows(*a), rows(*b), ["k"]).collect())
    assert diff([(t, 1.0)] * 3, [(t, 1.0)] * 3) == []
    assert diff([(t, 1.0), (t, 1.0), (t, 2.0)], [(t, 1.0), (t, 3.0)]) == ["changed", "removed"]
    assert diff([(t, 1.0)], [(t, 2.0), (t, 1.0), (t, 1.0)]) == ["added", "added"]
    assert diff([(None, 1.0)], [(None, 1.0)]) == []


@pytest.mark.parametrize("name", ["q_read_window", "q_window_features"])
def test_accounts_of_repeated_rows(spark, thrice, name):
    _same(spark, thrice, name)


TAGGED = "source_id string, point_id string, row_ix long, ts timestamp, value double, quality string"


def _numbered(spark, n=300):
    """Numbers close together, far apart and below zero; one value in ten is null."""
    draw = random.Random(3)
    ids = draw.sample([*range(-90, 90), *range(-(10**6), 10**6, 5003), *range(2**60, 2**60 + 200)], n)
    rows = [("s", f"p{i % 3}", i, datetime.fromtimestamp(draw.randrange(10**6), UTC), draw.choice([None] + [float(x) for x in range(9)]), "GOOD") for i in ids]
    return spark.createDataFrame(rows, TAGGED)


@pytest.mark.parametrize("ahead", [False, True])
def test_neighbours_over_blocks(spark, ahead):
    rows = _numbered(spark)
    plain = rows.withColumn("x", (F.lead if ahead else F.lag)("value").over(physics.by_row()))
    got = physics.neighbour(rows, "value", "x", ahead)
    assert got.columns == plain.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def _largest(spark, df):
    """Rows of the largest partition, and of all."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        found = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset(key)
    return max(found), sum(found)


def test_rows_of_one_tag_are_dealt_out(spark):
    t = [datetime.fromtimestamp(i, UTC) for i in range(240)]
    s = spark.createDataFrame([("s", "p", i << 13, t[i], float(i % 7), "GOOD") for i in range(240)], TAGGED)
    bounds = spark.createDataFrame([("s", "p", t[0], t[-1])], "source_id string, point_id string, start timestamp, end timestamp")
    for df in (physics.intervals(s), physics.read_window(s, bounds)[0]):
        most, n = _largest(spark, df)
        assert n == 240 and most < n


@pytest.mark.parametrize("is_few", [True, False])
def test_medians(spark, is_few):
    inf, nan = float("inf"), float("nan")
    groups = {"a": [1.0, 2.0], "b": [3.0], "c": [None, None], "d": [None, -1.0, -2.0, 5.0], "e": [0.0, -0.0, 1.0, 1.0], "f": [inf, -inf, 1.0, 2.0], "g": [nan, 1.0, 2.0], "h": [-1e300, 1e-300, 5e-324], "i": [0.1, 0.3], "j": [1.0, inf]}
    draw = random.Random(5)
    groups |= {"k": [draw.gauss(0, 1) for _ in range(500)], "l": [100 + 1e-9 * draw.random() for _ in range(501)], "m": [float(draw.randrange(4)) for _ in range(400)]}
    rows = spark.createDataFrame([("s", k, v) for k, x in groups.items() for v in x], "source_id string, point_id string, value double")
    want = {r["point_id"]: repr(r["m"]) for r in rows.groupBy("point_id").agg(F.median("value").alias("m")).collect()}
    assert {r["point_id"]: repr(r["median"]) for r in physics.median(rows, "value", is_few=is_few).collect()} == want
