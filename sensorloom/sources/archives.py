"""Archives: samples of all tags in one partitioned Parquet dataset, metadata beside them."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from datetime import datetime
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contract import TagMeta, meta_from_dict
from ..errors import InsufficientQuality, SchemaError
from ..functions.quality import RANK

SAMPLES = "source_id string, point_id string, row_ix long, ts timestamp, value double, state string, quality string"
TAGS = "source_id string, point_id string, name string, unit_raw string, unit_canonical string, eng_zero double, eng_span double, sample_rate_s double, asset string, loop_id string, role string, retrieval_mode string, quality_codes map<string,string>, quality_assumed boolean"


class Source(Protocol):
    """Where windows come from; nothing is ever written through it."""

    def list_tags(self) -> DataFrame: ...

    def samples(self) -> DataFrame: ...

    def window(self, start: datetime, end: datetime, points: list[str] | None = None) -> DataFrame: ...


#: The columns of a single-tag archive.
ARCHIVE = ("timestamp", "value", "quality")


def read_schema(spark: SparkSession, path: str):
    """The schema of a Parquet archive, from its footer alone; anything else is refused by name."""
    try:
        return spark.read.parquet(path).schema
    except Exception as e:  # Spark has no narrower class for a file that isn't Parquet
        raise SchemaError(f"{path} can't be read as Parquet ({type(e).__name__})") from e


def read_archives(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows of some single-tag archives with their place: path, row_ix and the chosen columns; only those are read."""
    for path in paths:
        lacking = [c for c in ARCHIVE if c not in read_schema(spark, path).names]
        if lacking:
            raise SchemaError(f"{path} has no column {', '.join(lacking)}")
    rows = spark.read.parquet(*paths)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_ix"), *(columns or rows.columns))


class SingleTag:
    """One Parquet archive of one tag, named by its metadata."""

    def __init__(self, spark: SparkSession, path: str, meta: TagMeta):
        self.spark, self.path, self.meta = spark, path, meta

    def list_tags(self) -> DataFrame:
        return self.spark.createDataFrame([(self.meta.source_id, self.meta.point_id)], "source_id string, point_id string")

    def samples(self) -> DataFrame:
        rows = read_archives(self.spark, [self.path], list(ARCHIVE))
        raw = rows.select(F.lit(self.meta.source_id).alias("source_id"), F.lit(self.meta.point_id).alias("point_id"), "row_ix", "timestamp", F.col("value").cast("string").alias("raw"), F.col("quality").cast("string").alias("quality"))
        return to_samples(raw, F.col("timestamp"))

    def window(self, start: datetime, end: datetime, points: list[str] | None = None) -> DataFrame:
        rows = self.samples().where(F.col("ts").between(F.lit(start), F.lit(end)))
        return rows.where(F.col("point_id").isin(points)) if points else rows


def safe_filename(name: str) -> str:
    """A name without what file systems don't take; dots alone are no name."""
    return re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", name).rstrip(". ") or "_"


def check_targets(root: str, points: Iterable[str], metas: dict[str, TagMeta], exists=os.path.exists) -> dict[str, str]:
    """The path of each tag's archive, before anything is written.

    Refused: tags without metadata, names that fall together on a file system that ignores case, and files that are there already.
    """
    points = list(points)
    lacking = [p for p in points if p not in metas]
    if lacking:
        raise SchemaError(f"no metadata for {', '.join(lacking)}")
    paths = {p: f"{root.rstrip('/')}/{safe_filename(metas[p].source_id)}/{safe_filename(p)}.parquet" for p in points}
    taken: dict[str, str] = {}
    for p, path in paths.items():
        if (other := taken.setdefault(path.casefold(), p)) != p:
            raise SchemaError(f"{other!r} and {p!r} would share one file")
    there = [path for path in paths.values() if exists(path)]
    if there:
        raise SchemaError(f"already there: {', '.join(there)}")
    return paths


class Store:
    """A folder of ``samples`` (partitioned by source) and ``tags``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, samples: DataFrame, metas: list[TagMeta], overwrite: bool = False) -> None:
        """Creates the store; an existing one is refused unless ``overwrite``."""
        mode = "overwrite" if overwrite else "errorifexists"
        rows = [tuple(getattr(m, c.split()[0]) for c in TAGS.split(", ")) for m in metas]
        dealt = samples.repartition("source_id", "point_id").sortWithinPartitions("source_id", "point_id", "row_ix")
        dealt.write.mode(mode).partitionBy("source_id").parquet(f"{self.root}/samples")
        self.spark.createDataFrame(rows, TAGS).coalesce(1).write.mode(mode).parquet(f"{self.root}/tags")

    def tags(self) -> DataFrame:
        return self.spark.read.schema(TAGS).parquet(f"{self.root}/tags")

    def list_tags(self) -> DataFrame:
        return self.tags().select("source_id", "point_id").distinct().orderBy("source_id", "point_id")

    def samples(self) -> DataFrame:
        return self.spark.read.schema(SAMPLES).parquet(f"{self.root}/samples")

    def window(self, start: datetime, end: datetime, points: list[str] | None = None) -> DataFrame:
        """Rows of the closed interval; source, point and stamp reach the scan."""
        rows = self.samples().where(F.col("ts").between(F.lit(start), F.lit(end)))
        return rows.where(F.col("point_id").isin(points)) if points else rows

    def extent(self) -> DataFrame:
        """tag, first, last: reads the stamps only; an empty store is refused."""
        rows = self.samples()
        if rows.isEmpty():
            raise InsufficientQuality(f"{self.root} holds no sample")
        return rows.groupBy("source_id", "point_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


def read_meta(path: str) -> TagMeta:
    with open(path, encoding="utf-8") as f:
        return meta_from_dict(json.load(f))


def read_csv(spark: SparkSession, path: str, sep: str = ",", decimal: str = ".", encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, with the row number in file order and the decimal mark set to a point where that parses."""
    rows = spark.read.csv(path, header=True, sep=sep, encoding=encoding, inferSchema=False)
    if len(rows.columns) == 1 and ";" in rows.columns[0] and sep != ";":
        raise SchemaError("the header has one column that holds ';'; state the separator")
    if decimal != ".":
        for c in rows.columns:
            swapped = F.replace(F.col(f"`{c}`"), F.lit(decimal), F.lit("."))
            rows = rows.withColumn(c, F.when(swapped.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), swapped).otherwise(F.col(f"`{c}`")))
    return rows.withColumn("row_ix", F.monotonically_increasing_id())


def from_wide(rows: DataFrame, stamp: str, source_id: str, suffix: str | None = None) -> DataFrame:
    """One column per tag, with quality columns by suffix, to samples."""
    quality = [c for c in rows.columns if suffix and c.endswith(suffix)]
    points = [c for c in rows.columns if c not in (stamp, "row_ix", *quality)]
    packed = rows.select(F.col(stamp).alias("stamp"), "row_ix", *(F.struct(F.col(f"`{p}`").cast("string").alias("raw"), (F.col(f"`{p}{suffix}`").cast("string") if f"{p}{suffix}" in quality else F.lit(None).cast("string")).alias("quality")).alias(p) for p in points))
    long = packed.unpivot(["stamp", "row_ix"], points, "point_id", "cell")
    return long.select(F.lit(source_id).alias("source_id"), "point_id", "row_ix", "stamp", "cell.raw", "cell.quality")


def from_long(rows: DataFrame, tag: str, stamp: str, value: str, source_id: str, quality: str | None = None) -> DataFrame:
    """One row per tag and stamp to samples; a blank tag is refused."""
    blank = rows.where(F.col(tag).isNull() | (F.trim(F.col(tag)) == "")).limit(1).count()
    if blank:
        raise SchemaError("a row names no tag")
    q = F.col(quality).cast("string") if quality else F.lit(None).cast("string")
    return rows.select(F.lit(source_id).alias("source_id"), F.col(tag).alias("point_id"), "row_ix", F.col(stamp).alias("stamp"), F.col(value).cast("string").alias("raw"), q.alias("quality"))


def to_samples(raw: DataFrame, ts, assume_quality: str | None = None) -> DataFrame:
    """Text cells to values: numbers by a guarded cast, other text is a state."""
    number = F.when(F.col("raw").rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.col("raw").try_cast("double"))
    q = F.coalesce("quality", F.lit(assume_quality)) if assume_quality else F.col("quality")
    return raw.select("source_id", "point_id", "row_ix", ts.alias("ts"), number.alias("value"), F.when(number.isNull() & (F.trim("raw") != ""), F.col("raw")).alias("state"), q.alias("quality"))


def meta_templates(samples: DataFrame) -> DataFrame:
    """tag, distinct raw quality codes and value strings, for a metadata file to fill in."""
    return samples.groupBy("source_id", "point_id").agg(F.sort_array(F.collect_set("quality")).alias("quality_codes"), F.sort_array(F.collect_set("state")).alias("value_strings"))


def quality_code_template(samples: DataFrame) -> DataFrame:
    """tag, codes: each distinct raw code, with its severity where it spells one and null where a person must say."""
    spelt = F.upper(F.trim("quality"))
    name = F.when(spelt.isin(list(RANK)), spelt)
    codes = samples.where(F.col("quality").isNotNull()).select("source_id", "point_id", "quality", name.alias("severity")).distinct()
    return codes.groupBy("source_id", "point_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("quality", "severity")))).alias("codes"))


def interleaved(rows: DataFrame, columns: list[str], stamp: str = "ts") -> str | None:
    """The first column whose values split one export into several series, each forwards in time and overlapping others.

    Groups must have two rows or more, and there must be two groups; each column costs one aggregate.
    """
    for c in columns:
        w = Window.partitionBy(c).orderBy("row_ix")
        steps = rows.withColumn("_back", F.col(stamp) <= F.lag(stamp).over(w))
        groups = steps.groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.min(stamp).alias("a"), F.max(stamp).alias("b"), F.coalesce(F.bool_or("_back"), F.lit(False)).alias("back"))
        sums = groups.agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"), F.bool_or("back").alias("back"), F.min("b").alias("b"), F.max("a").alias("a")).first()
        if sums["k"] >= 2 and sums["n"] >= 2 and not sums["back"] and sums["a"] < sums["b"]:
            return c
    return None


def ingest(spark: SparkSession, rows: DataFrame, root: str, metas: list[TagMeta], stamp, assume_quality: str | None = None) -> Store:
    """Raw cells (``from_wide`` or ``from_long``) into a new store; every check is made before the first write.

    stamp: the column of instants. Refused: tags without metadata, quality that is both in the data
    and assumed, stamps that can't be read, run backwards or repeat, and text in tags without states.
    """
    known = {(m.source_id, m.point_id): m for m in metas}
    points = [(r["source_id"], r["point_id"]) for r in rows.groupBy("source_id", "point_id").agg(F.min("row_ix").alias("first")).orderBy("first").limit(MAX_TAGS + 1).collect()]
    if len(points) > MAX_TAGS:
        raise SchemaError(f"more than {MAX_TAGS} tags in one export")
    lacking = [":".join(p) for p in points if p not in known]
    if lacking:
        raise SchemaError(f"no metadata for {', '.join(lacking)}")
    if assume_quality and not rows.where(F.col("quality").isNotNull()).isEmpty():
        raise SchemaError("the export has quality codes; none can be assumed")
    samples = to_samples(rows, stamp, assume_quality)
    modes = [m.point_id for m in metas if m.role == "MODE"]
    w = Window.partitionBy("source_id", "point_id").orderBy("row_ix")
    told = samples.withColumn("_prev", F.lag("ts").over(w)).groupBy("source_id", "point_id").agg(
        F.count_if(F.col("ts").isNull()).alias("unread"),
        F.count_if(F.col("ts") < F.col("_prev")).alias("back"),
        F.count_if(F.col("ts") == F.col("_prev")).alias("twice"),
        F.count_if(F.col("state").isNotNull() & ~F.col("point_id").isin(modes)).alias("text"),
    )
    bad = told.where("unread + back + text > 0").orderBy("source_id", "point_id").first()
    if bad:
        raise SchemaError(f"{bad['source_id']}:{bad['point_id']}: {bad['unread']} stamps can't be read, {bad['back']} rows run backwards, {bad['text']} values are text")
    store = Store(spark, root)
    store.write(samples, [known[p] for p in points])
    return store


#: Tags of one export; their metadata is a list on the driver.
MAX_TAGS = 100_000
