"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target size by its weight, capped at three times its own size, the excess
shared out again by weight. A document of a source is then worth ``target / source size``
copies: the whole part is given at once, and the fractional parts are rounded dependently.
Two fractions meet, and words move at random from one to the other until one of them is 0 or 1;
the other keeps the rest, so a pair keeps its expected words.

Large documents come first, a thousandth of their source or more (at most ``1 / LARGE`` of them a
source). Each is paired with all smaller ones of its source together: it becomes whole, and the
words it got too many or too few change the fractions of all the others alike. The small ones are
rounded in a reduction tree: leaves hold about ``FAN_IN`` documents of one source (a hot source has
many leaves); each leaf hands at most one unrounded document up, and these meet in the same way
until one is left per source, which a coin of its own fraction decides.

All draws are hashes of (seed, level, document), so reruns agree. Rows that are equal in all that
counts are numbered first, so that each has a draw and a leaf of its own.

Defined cases: a null text has size 0; a null source is a source of its own, last in order;
documents of size 0 are rounded by coins of their own and take no words; repeated rows are rounded
one by one; an empty table gives an empty result; other columns pass through ``mix`` untouched.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered, prefix_sums, stage, unused, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
FAN_IN = 1024
#: Share of its source from which a document is rounded against all smaller ones together.
LARGE = 0.001
#: Sources joined by broadcast up to this many rows, about 16 MB.
MAX_BROADCAST = 200_000
EDGE = 1e-9


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_index, source_size, target: weights repeat over sources by code point, null last."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.lit(1).alias("one"))
    table = prefix_sums(sums, [F.col("source").asc_nulls_last()], "one", "source_index")
    table = stage(table.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_index") % len(weights) + 1).cast("int"))), "sources")
    cap = F.lit(float(most)) * F.col("source_size")
    row = table.agg(F.sum("source_size"), F.sum("w")).first()
    total, level, capped = float(row[0] or 0), float(row[0] or 0) / float(row[1] or 1), -1
    while True:  # each round caps at least one more source, or ends
        over = F.col("w") * F.lit(level) > cap
        n, held, free = table.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("w")))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - (held or 0.0)) / free
    return table.select("source", "source_index", "source_size", F.least(cap, F.col("w") * F.lit(level)).alias("target"))


def _large(frame: pd.DataFrame, most: int) -> pd.DataFrame:
    """Rounds the large documents of a source, the largest first; ``rest`` are the words of the others.

    ``shift`` is what the fractions of all documents still open have changed by.
    """
    frame = frame.sort_values(["size", "key"], ascending=[False, True], kind="stable")
    size, draw = frame["size"].to_numpy(float), frame["u"].to_numpy(float)
    share, rest, shift, copies = float(frame["share"].iloc[0]), float(frame["rest"].iloc[0]), 0.0, []
    open_words = size.sum() + rest
    for s, u in zip(size.tolist(), draw.tolist(), strict=True):
        p = min(max(share + shift, 0.0), float(most))
        whole = min(int(p + EDGE), most)
        copies.append(whole + int(u < p - whole))
        open_words -= s
        if open_words > 0:  # what this one got too little or too much, and what its bounds held back
            shift += s * (share + shift - copies[-1]) / open_words
    return pd.DataFrame({"rid": frame["rid"], "source_index": frame["source_index"], "copies": copies, "shift": shift})


def _pivot(frame: pd.DataFrame, last: bool) -> pd.DataFrame:
    """Rounds the fractions of one leaf; ``up`` stays null for the one that is handed on."""
    frame = frame.sort_values(["size", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
    size, p, u = frame["size"].to_numpy(float), frame["p"].to_numpy(float).copy(), frame["u"].to_numpy(float)
    up: list[int | None] = [None] * len(p)
    held = -1
    for i in range(len(p)):
        if p[i] < EDGE or p[i] > 1 - EDGE:
            up[i] = int(p[i] > 0.5)
            continue
        if held < 0:
            held = i
            continue
        # words that can move to the one held, and from it, until one of the two is whole
        rise = min((1 - p[held]) * size[held], p[i] * size[i])
        fall = min(p[held] * size[held], (1 - p[i]) * size[i])
        move = rise if u[i] * (rise + fall) < fall else -fall
        p[held] += move / size[held]
        p[i] -= move / size[i]
        done = [k for k in (held, i) if p[k] < EDGE or p[k] > 1 - EDGE]
        for k in done:
            up[k] = int(p[k] > 0.5)
        left = [k for k in (held, i) if k not in done]
        held = left[0] if left else -1
    if last and held >= 0:
        up[held] = int(u[held] < p[held])
    frame["p"] = p
    frame["up"] = pd.array(up, dtype="Int32")
    return frame[["rid", "source_index", "size", "key", "p", "up"]]


_LEAF = "rid long, source_index long, size long, key long, p double, up int"


def _draw(level: int, seed: int):
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), "key"), 11)).cast("double") / F.lit(float(1 << 53))


def _told_apart(rows: DataFrame) -> DataFrame:
    """Makes ``key`` differ for rows of one key: they are numbered, however many there are.

    A row's number counts the rows of its key in the input's earlier partitions (the upper bits
    of ``rid``), then those before it in its own; no task holds all rows of a key.
    """
    rows = rows.withColumn("_part", F.shiftright("rid", 33))
    before = rows.groupBy("key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("key")
    base = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = before.withColumn("_all", F.sum("_n").over(whole)).withColumn("_base", F.coalesce(base, F.lit(0))).where("_all > 1")
    found = rows.join(before.select("key", "_part", "_base"), ["key", "_part"], "left")
    number = F.col("_base") + F.row_number().over(Window.partitionBy("key", "_part").orderBy("rid")) - 1
    return found.withColumn("key", F.when(F.col("_base").isNull(), F.col("key")).otherwise(F.xxhash64("key", number))).select(*(c for c in rows.columns if c != "_part"))


def copies(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 17, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, fan_in: int = FAN_IN) -> DataFrame:
    """rid, doc_id, size, source_size, target, copies for every row of ``docs``."""
    slim = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(doc_id), F.col(source), F.col(text)).alias("key"))
    return _copies(stage(slim, "sizes"), seed, weights, most, fan_in)


def _copies(slim: DataFrame, seed: int, weights: tuple[float, ...], most: int, fan_in: int) -> DataFrame:
    """slim: rid (a monotonically increasing id), doc_id, source, size, key."""
    wanted = targets(slim, weights, most)
    large = F.col("size") >= F.greatest(LARGE * F.col("source_size"), F.lit(1))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = stage(wanted.withColumn("share", share).withColumnRenamed("source", "_source"), "wanted")
    few = wanted.count() <= MAX_BROADCAST
    near = F.broadcast if few else (lambda df: df)
    rows = stage(_told_apart(slim).join(near(wanted), F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source").withColumn("large", large), "fractions")
    rest = rows.where("not large").groupBy("source_index").agg(F.sum("size").alias("rest"), F.count(F.lit(1)).alias("n"))
    rest = stage(rest, "rest")
    big = rows.where("large").join(near(rest.select("source_index", "rest")), "source_index", "left").na.fill(0, ["rest"])
    big = big.select("rid", "source_index", "size", "key", "share", "rest", _draw(0, seed).alias("u"))
    big = stage(big.groupBy("source_index").applyInPandas(lambda f: _large(f, most), "rid long, source_index long, copies int, shift double"), "large")
    # the words that the large ones left over or took too many change the small ones' fractions alike
    moved = big.groupBy("source_index").agg(F.first("shift").alias("shift"))
    salts = stage(rest.join(moved, "source_index", "left").select("source_index", F.coalesce("shift", F.lit(0.0)).alias("shift"), F.ceil(F.col("n") / fan_in).cast("long").alias("salts")), "leaves")
    small = rows.where("not large").join(near(salts), "source_index")
    total = F.least(F.greatest(F.col("share") + F.when(F.col("size") > 0, F.col("shift")).otherwise(0.0), F.lit(0.0)), F.lit(float(most)))
    whole = F.least(F.floor(total + EDGE), F.lit(most)).cast("int")
    small = small.select("rid", "source_index", "size", "key", whole.alias("whole"), (total - whole).alias("p"), F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("salts")).alias("leaf"))
    small = stage(small, "small")
    leaf = lambda last: lambda frame: _pivot(frame, last)
    first = small.where("size > 0").select("rid", "source_index", "size", "key", "p", "leaf", _draw(1, seed).alias("u"))
    done = stage(first.groupBy("source_index", "leaf").applyInPandas(leaf(False), _LEAF), "level1")
    coins = small.where("size = 0").select("rid", (_draw(1, seed) < F.col("p")).cast("int").alias("up"))
    decided, level = coins.unionByName(done.where("up is not null").select("rid", "up")), 2
    left = done.where("up is null")
    most_left = left.groupBy("source_index").count().agg(F.max("count")).first()[0] or 0
    while most_left:
        salts = -(-most_left // fan_in)
        last = salts == 1
        again = left.select("rid", "source_index", "size", "key", "p", F.pmod(F.xxhash64(F.lit(seed + level), "key"), F.lit(salts)).alias("leaf"), _draw(level, seed).alias("u"))
        done = stage(again.groupBy("source_index", "leaf").applyInPandas(leaf(last), _LEAF), f"level{level}")
        decided, left = decided.union(done.where("up is not null").select("rid", "up")), done.where("up is null")
        if last:
            break
        most_left, level = left.groupBy("source_index").count().agg(F.max("count")).first()[0] or 0, level + 1
    chosen = small.select("rid", "whole").join(decided, "rid").select("rid", (F.col("whole") + F.col("up")).alias("copies"))
    return rows.select("rid", "doc_id", "size", "source_size", "target").join(chosen.union(big.select("rid", "copies")), "rid")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 17, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, fan_in: int = FAN_IN) -> DataFrame:
    """The mixed documents: each row as often as it is taken, with its own columns."""
    rid, times, copy = unused("rid", docs), unused("times", docs), unused("copy", docs)
    rows = numbered(docs, rid)
    slim = rows.select(F.col(rid).alias("rid"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(doc_id), F.col(source), F.col(text)).alias("key"))
    taken = _copies(stage(slim, "sizes"), seed, weights, most, fan_in).select(F.col("rid").alias(rid), F.col("copies").alias(times)).where(F.col(times) > 0)
    return rows.join(taken, rid).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """The digest of query op10."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")
