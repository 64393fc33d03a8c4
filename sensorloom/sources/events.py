"""The ``events`` table as process samples: one tag per event type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source_id", "point_id"]
ENG_ZERO, ENG_SPAN, RATE_S = 0.0, 150.0, 900.0


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, point_id, row_ix, ts, value, quality; stamps are declared to be UTC.

    The JSON is read once a row: its number picks the code from a list.
    """
    codes = ["GOOD"] * 80 + ["0"] * 4 + ["10813440"] * 4 + ["1073741824"] * 2 + ["2147483648"] * 2 + ["257"] * 2
    codes += ["250", "COMM FAILURE", " substituted ", "192", "SENSOR DRIFT"]
    quality = F.get(F.array(*map(F.lit, codes)), F.get_json_object("props", "$.k").cast("int"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.lit("events").alias("source_id"), F.col("event_type").alias("point_id"), F.col("event_id").alias("row_ix"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"), quality.alias("quality"))


#: The same adapter as DuckDB SQL, for the oracles.
SQL = """
s AS (SELECT 'events' AS source_id, event_type AS point_id, event_id AS row_ix, ts, value,
        CASE WHEN k < 80 THEN 'GOOD' WHEN k <= 83 THEN '0' WHEN k <= 87 THEN '10813440' WHEN k <= 89 THEN '1073741824'
             WHEN k <= 91 THEN '2147483648' WHEN k <= 93 THEN '257' WHEN k = 94 THEN '250' WHEN k = 95 THEN 'COMM FAILURE'
             WHEN k = 96 THEN ' substituted ' WHEN k = 97 THEN '192' WHEN k = 98 THEN 'SENSOR DRIFT' END AS quality, k
      FROM (SELECT *, json_extract(props, '$.k')::INT AS k FROM events)),
a AS (SELECT source_id, point_id, row_ix, ts, quality,
        CASE WHEN k BETWEEN 92 AND 94 THEN NULL ELSE value END AS value, value AS raw_value, k,
        CASE WHEN k <= 87 THEN 'GOOD' WHEN k <= 89 THEN 'UNCERTAIN' WHEN k <= 93 THEN 'BAD' WHEN k = 94 THEN 'UNCERTAIN'
             WHEN k = 95 THEN 'BAD' ELSE 'UNCERTAIN' END AS severity,
        coalesce(k >= 97, true) AS unmapped, coalesce(k BETWEEN 92 AND 93, false) AS range_state,
        coalesce(k <= 87, false) AS valid
      FROM s)
"""
