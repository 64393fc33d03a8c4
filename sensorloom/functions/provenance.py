"""Fingerprints of data and the replay of recorded results."""

from __future__ import annotations

import hashlib
import json
import platform
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(ts: Column, value: Column, quality: Column) -> Column:
    """SHA-256 of stamp (microseconds), value and quality; a value counts to nine decimals."""
    text = F.concat_ws("\n", F.unix_micros(ts).cast("string"), F.coalesce(F.round(value * 1e9).cast("decimal(38,0)").cast("string"), F.lit("null")), F.coalesce(quality, F.lit("null")))
    return F.sha2(text.cast("binary"), 256)


def fingerprint(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, fingerprint: order doesn't matter. Row hashes are summed in eight 32-bit lanes before they are hashed."""
    h = row_hash(F.col("ts"), F.col("value"), F.col("quality"))
    lane = lambda i: F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *(lane(i) for i in range(8))).cast("binary"), 256).alias("fingerprint"))


def diff_frames(before: DataFrame, after: DataFrame, keys: list[str], row: tuple[str, ...] = ()) -> DataFrame:
    """keys, ts, change: removed, added or changed, one row for each row that differs.

    Rows meet by key and stamp, and by ``row`` where they have names of their own. Where several meet,
    equal rows cancel one for one; as many of the rest as both sides have are changed.
    """
    at = [*keys, *row, "ts"]
    side = lambda df, n: df.select(*at, row_hash(F.col("ts"), F.col("value"), F.col("quality")).alias("_h"), F.lit(n).cast("long").alias("_n"))
    left = side(before, 1).unionByName(side(after, -1)).groupBy(*at, "_h").agg(F.sum("_n").alias("_n")).where("_n <> 0")
    rest = lambda n: F.sum(F.greatest(n, F.lit(0).cast("long")))
    both = left.groupBy(*at).agg(rest(F.col("_n")).alias("_b"), rest(-F.col("_n")).alias("_a")).withColumn("_c", F.least("_b", "_a"))
    kind = lambda name, n: F.array_repeat(F.lit(name), n.cast("int"))
    each = F.concat(kind("changed", F.col("_c")), kind("removed", F.col("_b") - F.col("_c")), kind("added", F.col("_a") - F.col("_c")))
    return both.select(*keys, "ts", F.explode(each).alias("change"))


def env_fingerprint() -> dict:
    import numpy
    import pyspark

    return {"python": platform.python_version(), "numpy": numpy.__version__, "pyspark": pyspark.__version__}


@dataclass(frozen=True)
class Record:
    name: str
    data: str
    code: str
    result: str
    env: dict

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Record:
        return Record(**json.loads(text))


def make_record(name: str, data: str, code: str, result: dict) -> Record:
    return Record(name, data, hashlib.sha256(code.encode()).hexdigest(), hashlib.sha256(json.dumps(result, sort_keys=True).encode()).hexdigest(), env_fingerprint())


def replay(record: Record, data: str, result: dict) -> str:
    """MATCH, CODE_DRIFT, DATA_CHANGED or BOTH."""
    same_data = data == record.data
    same = hashlib.sha256(json.dumps(result, sort_keys=True).encode()).hexdigest() == record.result
    return "MATCH" if same_data and same else "CODE_DRIFT" if same_data else "DATA_CHANGED" if same else "BOTH"
