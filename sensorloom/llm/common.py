"""Shared helpers of the corpus operators: staged tables, prefix sums, components, text rules."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII letters only; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space that parts words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch between the JVM and Python; a worker holds a few times as much.
BATCH = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Keeps Arrow batches small, so that long texts don't add up in a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(key)
    if not (size.rstrip("b").isdigit() and 0 < int(size.rstrip("b")) <= BATCH):
        spark.conf.set(key, str(BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is configured."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(found)
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.environ.get("SENSORLOOM_SHARED")
    if not own:
        own = os.environ["SENSORLOOM_SHARED"] = tempfile.mkdtemp(prefix="sensorloom-")
        atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/loom-{uuid.uuid4().hex[:12]}-{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    with lent():  # what the driver collected before may be gone by now
        pass
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries run in here drop their own shuffle files as they end, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def drop_stage(staged: DataFrame) -> None:
    """Removes a staged table that nothing reads any more."""
    drop_path(staged.sparkSession, staged._staged_at)


def unused(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def numbered(docs: DataFrame, name: str = "rid") -> DataFrame:
    """The rows with a number each, written down: a second reading deals them alike, whatever executors are left."""
    return stage(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts 0."""
    ws = "[\\x09-\\x0D\\x20]"
    n = F.size(F.split(text, f"{ws}+", -1)) - text.rlike(f"\\A{ws}").cast("int") - text.rlike(f"{ws}\\z").cast("int")
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(n).cast("long")


def fold(column: Column, parts: int) -> Column:
    """crc32 of an id's decimal text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % parts


def prefix_sums(df: DataFrame, order: list[Column], value: str, out: str, part: str | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before, in a total order.

    Rows are dealt by ranges of the order; only one total per range goes to the driver. The
    ranges must not change between the two passes, so the dealt rows are staged. ``part`` names
    a column for the number of a row's range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    dealt = stage(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    totals = {r["_part"]: r["t"] or 0 for r in dealt.groupBy("_part").agg(F.sum(value).alias("t")).collect()}
    before, run = {}, 0
    for k in sorted(totals):
        before[k], run = run, run + totals[k]
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    base = spark.createDataFrame([(p, b) for p, b in before.items()] or [(-1, 0)], "_part int, _base long")
    rows = dealt.join(F.broadcast(base), "_part").withColumn(out, F.col("_base") + F.coalesce(inside, F.lit(0)))
    return (rows.withColumn(part, F.col("_part")) if part else rows).drop("_part", "_at", "_base")


def with_least(rows: DataFrame, key: str, value: str, out: str, n: int | None = None) -> DataFrame:
    """Adds ``out``: the smallest ``value`` of a row's ``key``.

    Keys that hold more than one in ``HOT_SHARE`` of all rows are met by broadcast (twice
    ``HOT_SHARE`` of them at most), so their rows are not sent to one task; the rest by a join.
    """
    n = rows.count() if n is None else n
    least = rows.groupBy(key).agg(F.min(value).alias(out), F.count(F.lit(1)).alias("_n"))
    bound = max(HOT_LEAST, n // HOT_SHARE)
    if n <= bound:
        return rows.join(least.drop("_n"), key)
    hot = least.where(F.col("_n") > bound).drop("_n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(least.where(F.col("_n") <= bound).drop("_n"), key)
    return rest.unionByName(rows.join(F.broadcast(hot), key))


HOT_LEAST, HOT_SHARE = 256, 4000


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Smallest id reachable from each linked node: (node, component_id).

    Alternates the large-star and small-star steps until no link changes. Each step is a
    minimum per node, met again by the node's links; a hub's links stay where they are.
    """
    edges = stage(links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo <> hi").distinct(), "links")
    mark, n = None, edges.count()
    for _ in range(rounds):
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select("hi", "lo"))
        large = with_least(both, "u", "v", "m", 2 * n).where("v > u").select(F.least("u", "m").alias("lo"), F.col("v").alias("hi"))
        large = large.where("lo <> hi").distinct()
        small = with_least(large, "hi", "lo", "m", n).select("m", F.explode(F.array("lo", "hi")).alias("hi"))
        before, edges = edges, stage(small.where("m <> hi").select(F.col("m").alias("lo"), "hi").distinct(), "links")
        drop_stage(before)
        n, now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if (n, now) == mark:
            break
        mark = (n, now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("lo").alias("node")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component_id")).union(roots.select("node", F.col("node")))


#: A key filter never has more bits than this: half a million words, about 25 MB broadcast.
MAX_FILTER_BITS = 1 << 25


def key_mark(rows: DataFrame, column: str, keys: DataFrame, key: str, out: str) -> DataFrame:
    """Adds the boolean ``out``: false only for rows whose ``column`` is not among the keys.

    A bitmap with one bit per hashed key, joined by broadcast as 64-bit words. Its size is
    bounded; once full it lets more rows through, which the exact join behind it sorts out.
    """
    n = max(1, keys.count())
    bits = min(MAX_FILTER_BITS, 1 << max(12, (16 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))
    words = keys.select(place(key).alias("p")).select(F.shiftright("p", 6).alias("_w"), bit(F.col("p")).alias("_v")).groupBy("_w").agg(F.bit_or("_v").alias("_v"))
    found = rows.withColumn("_p", place(column)).withColumn("_w", F.shiftright("_p", 6)).join(F.broadcast(words), "_w", "left")
    return found.withColumn(out, F.coalesce(F.col("_v").bitwiseAND(bit(F.col("_p"))) != 0, F.lit(False))).drop("_w", "_p", "_v")


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


@contextmanager
def lent(*caches: dict) -> Iterator[None]:
    """Around the batches of a Python task: at its end empties the caches and hands free memory back.

    Workers outlive their tasks, so what one leaves behind would stand beside the next stage's.
    """
    try:
        yield
    finally:
        for c in caches:
            c.clear()
        pa.default_memory_pool().release_unused()
        if _TRIM:
            _TRIM(0)
