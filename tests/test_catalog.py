"""Every registered query with a DuckDB form gives its rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from sensorloom.operators import baselines
from sensorloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(rows):
    def one(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 5) + 0.0
        return x

    return sorted((tuple(one(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert _plain([[r[c] for c in cols] for r in got.collect()]) == _plain([[r[i] for i in at] for r in want.fetchall()])


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and all(0 <= r["coverage"] <= 1 for r in rows)


def test_xbar_r_of_all_rows(spark, duck):
    got = {r["point_id"]: r for r in catalog.QUERIES["q_xbar_r"](spark, SF).collect()}
    n = dict(duck.sql(f"WITH {catalog.events.SQL} SELECT point_id, count(*) FILTER (valid) FROM a GROUP BY ALL").fetchall())
    assert {p: r["n_groups"] * 5 + r["n_left"] for p, r in got.items()} == n
    # a shift late in the day moves the center
    rows = [("s", "p", i, 0.0 if i < 5 else 10.0, "d") for i in range(22)]
    one = baselines.xbar_r_whole(spark.createDataFrame(rows, "source_id string, point_id string, row_ix long, value double, day string"), 5, "day").first()
    assert (one["n_groups"], one["n_left"], one["xbar"], one["rbar"]) == (4, 2, 7.5, 0.0)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
