"""Embedding near-duplicates by cross-polytope hashing.

Each unit vector is padded to a power of two and turned by three rounds of random signs and fast
Hadamard transforms; a hash is the signed axis it then lies nearest to, and ``k`` of them make a
bucket. A vector stands in its own bucket of each table and probes the next best ones. Vectors
that meet in a bucket are compared by cosine in double precision.

Every row of a bucket carries its buckets of all tables, so that a pair is counted only in the
first table where it meets; no pair is ever written out. A bucket yields a count of links per
vector and one edge per vector to the smallest of its component in that bucket. Equal vectors
are one class, compared once. Buckets of more than ``BLOCK`` rows are compared in pairs of blocks.

``k`` follows from the number of vectors; the number of tables follows from a simulation of
pairs at the threshold, such that such a pair is missed with probability ``MISS`` at most.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite component links
with nothing; vectors of different lengths don't link; repeated rows are equal vectors and link;
a null id sorts last; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, components, lent, stage, with_least

COSINE = 0.9
MISS = 1e-4
PROBES = 2
BLOCK = 1024
#: Hot buckets joined by broadcast up to this many rows.
MAX_BROADCAST = 100_000
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis, whose length is a power of two."""
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x / math.sqrt(n)


class Hasher:
    """``tables`` bucket codes of ``k`` hashes each, and ``PROBES`` further codes per table."""

    def __init__(self, dim: int, k: int, tables: int, seed: int = SEED):
        self.dim, self.k, self.tables = dim, k, tables
        self.size = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng([seed, dim]).choice([-1.0, 1.0], (tables, k, 3, self.size))

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + PROBES) bucket codes; the first is the vector's own."""
        x = np.zeros((len(unit), self.size))
        x[:, : self.dim] = unit
        out = np.empty((len(unit), self.tables, 1 + PROBES), np.int64)
        base = 2 * self.size
        for t in range(self.tables):
            best, second, loss = [], [], []
            for j in range(self.k):
                y = x
                for r in range(3):
                    y = hadamard(y * self.signs[t, j, r])
                at = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :3]
                top = np.take_along_axis(y, at, 1)
                best.append(at[:, 0] + self.size * (top[:, 0] < 0))
                second.append(at + self.size * (top < 0))
                loss.append(np.abs(top[:, :1]) - np.abs(top))
            own = sum(b * base**j for j, b in enumerate(best))
            out[:, t, 0] = own
            # every single change to the second or third axis, the cheapest first
            change = np.concatenate([(second[j][:, 1:] - best[j][:, None]) * base**j for j in range(self.k)], 1)
            cost = np.concatenate([loss[j][:, 1:] for j in range(self.k)], 1)
            order = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
            out[:, t, 1:] = own[:, None] + np.take_along_axis(change, order, 1)
        return out


def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two vectors meet, by table: one's own code is among the other's codes."""
    return (a[..., :1] == b).any(-1) | (b[..., :1] == a).any(-1)


def tables_for(dim: int, k: int, cosine: float = COSINE, miss: float = MISS, pairs: int = 4000) -> int:
    """Tables needed so that a pair of this cosine is missed with probability ``miss``."""
    rng = np.random.default_rng(3)
    a = rng.standard_normal((pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((pairs, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    h = Hasher(dim, k, 4)
    p = met(h.codes(a), h.codes(cosine * a + math.sqrt(1 - cosine**2) * b)).mean()
    return max(4, math.ceil(math.log(miss) / math.log(max(1e-6, 1 - 0.95 * p))))


def hashes_for(vectors: int, dim: int) -> int:
    """Hashes per code: about 64 vectors in a bucket of unrelated ones."""
    return max(1, math.ceil(math.log(max(vectors, 2) / 64) / math.log(2 * (1 << max(1, (dim - 1).bit_length())))))


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def code_type(k: int, dim: int) -> str:
    """The narrowest integers that hold the codes of ``k`` hashes."""
    bits = k * (1 + max(1, (dim - 1).bit_length()))
    return "<u2" if bits <= 16 else "<u4" if bits <= 32 else "<i8"


def _rows_of(column: pa.Array, first: int, after: int, kind: str) -> np.ndarray:
    """Packed rows of a binary column as one matrix."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset + first : column.offset + after + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(after - first, -1)


def _compare(ids: np.ndarray, unit: np.ndarray, codes: np.ndarray, weight: np.ndarray, own: np.ndarray, side: np.ndarray, same: bool, table: int, code: int, cosine: float):
    """Links in one block pair: weight of links first met here by row, and component by row."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 0 if same else side == 1)
    hit = unit[left] @ unit[right].T >= cosine
    hit &= (own[left][:, None] | own[right][None, :]) & (ids[left][:, None] != ids[right][None, :])
    i, j = np.nonzero(hit)
    i, j = left[i], right[j]
    label = np.arange(len(ids))
    if not len(i):
        return np.zeros(len(ids), np.int64), label
    while True:  # smallest row reachable in this block pair
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    before = met(codes[i][:, :table], codes[j][:, :table]).any(-1) if table else np.zeros(len(i), bool)
    # two vectors that probe each other's buckets meet twice in a table: the smaller code counts
    a, b = codes[i, table], codes[j, table]
    twice = (a[:, :1] == b).any(-1) & (b[:, :1] == a).any(-1) & (a[:, 0] != b[:, 0])
    before |= twice & (np.minimum(a[:, 0], b[:, 0]) != code)
    i, j = i[~before], j[~before]
    count = np.bincount(i, weights=weight[j], minlength=len(ids))
    if not same:
        count += np.bincount(j, weights=weight[i], minlength=len(ids))
    return count.astype(np.int64), label


def links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """rid, vec_id, n_links, component_id, first (the one row of its component that stays)."""
    spark = vectors.sparkSession
    bounded(spark)

    @F.pandas_udf("dim int, digest binary")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for v in b:
                x = np.array([np.nan if y is None else y for y in v], np.float64) if v is not None and len(v) else np.zeros(0)
                with np.errstate(over="ignore"):
                    good = len(x) and np.isfinite(x).all() and np.isfinite(x @ x) and x @ x > 0
                rows.append((len(x), hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest()) if good else (0, None))
            yield pd.DataFrame(rows, columns=["dim", "digest"])

    real = "<f4" if dict(vectors.dtypes)[embedding] == "array<float>" else "<f8"
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = stage(rows.withColumn("d", describe("v")).select("rid", "vec_id", F.when(F.col("d.digest").isNotNull(), F.col("v")).alias("v"), "d.dim", "d.digest"), "vectors")
    order = F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "rid")
    classes = stage(rows.where("digest is not null").groupBy("digest").agg(F.min("rid").alias("cid"), F.min(order).alias("least"), F.count(F.lit(1)).alias("weight")), "classes")
    nodes = rows.join(classes.select(F.col("cid").alias("rid"), "weight"), "rid").select(F.col("rid").alias("cid"), "v", "dim", "weight")
    plans = {}
    for r in classes.join(rows.select(F.col("rid").alias("cid"), "dim"), "cid").groupBy("dim").count().collect():
        k = hashes_for(r["count"], r["dim"])
        plans[r["dim"]] = (k, tables_for(r["dim"], k, cosine, miss))
    shared = spark.sparkContext.broadcast(plans)

    @F.pandas_udf("vec binary, met binary, codes array<array<long>>")
    def hashed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        with lent():
            for vs, dims in batches:
                out: list = [None] * len(vs)
                for dim in dims.unique().tolist():
                    at, plan = np.flatnonzero(dims.to_numpy() == dim), shared.value[dim]
                    x = np.stack([vs.iloc[i] for i in at]).astype(np.float64)
                    codes, kind = Hasher(dim, *plan).codes(_units(x)), code_type(plan[0], dim)
                    for i, v, c in zip(at, x.astype(real), codes, strict=True):
                        out[i] = (v.tobytes(), c.astype(kind).tobytes(), list(c))
                yield pd.DataFrame(out, columns=["vec", "met", "codes"])

    coded = stage(nodes.withColumn("h", hashed("v", "dim")).select("cid", "dim", "weight", "h.*"), "codes")
    places = coded.select("cid", "vec", "met", "dim", "weight", F.posexplode("codes").alias("t", "mine"))
    places = places.select("cid", "vec", "met", "dim", "weight", "t", F.posexplode("mine").alias("rank", "code"))
    hot = places.groupBy("dim", "t", "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    hot = stage(hot.select("dim", "t", "code", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hot")
    if hot.count() <= MAX_BROADCAST:
        hot = F.broadcast(hot)
    placed = places.join(hot, ["dim", "t", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("cid", "vec", "weight", "met", "dim", "t", "code", (F.col("rank") == 0).alias("own"), F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    keys = ["dim", "t", "code", "bi", "bj"]
    dealt = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def tally(table: pa.Table, ends: list[int]):
            ids, n, to, last = [], [], [], 0
            cid, weight = table["cid"].to_numpy(), table["weight"].to_numpy()
            own, side = table["own"].to_numpy(zero_copy_only=False), table["side"].to_numpy()
            t, code, bi, bj = table["t"].to_numpy(), table["code"].to_numpy(), table["bi"].to_numpy(), table["bj"].to_numpy()
            vec, codes, dim = table["vec"].combine_chunks(), table["met"].combine_chunks(), table["dim"].to_numpy()
            for end in ends:
                if end - last > 1 and own[last:end].any():
                    s = slice(last, end)
                    unit = _units(_rows_of(vec, last, end, real).astype(np.float64))
                    kind = code_type(shared.value[int(dim[last])][0], int(dim[last]))
                    mine = _rows_of(codes, last, end, kind).astype(np.int64).reshape(end - last, -1, 1 + PROBES)
                    count, label = _compare(cid[s], unit, mine, weight[s], own[s], side[s], bi[last] == bj[last], int(t[last]), int(code[last]), cosine)
                    for i in np.flatnonzero((count > 0) | (label != np.arange(end - last))):
                        ids.append(int(cid[last + i]))
                        n.append(int(count[i]))
                        to.append(int(cid[last + label[i]]))
                last = end
            return pa.RecordBatch.from_pydict({"cid": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "to": pa.array(to, pa.int64())})

        def ends_of(table: pa.Table) -> np.ndarray:
            key = np.stack([table[c].to_numpy().astype(np.int64) for c in keys])
            return np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            ends = ends_of(table) if len(table) else []
            if len(ends):
                yield tally(table, ends.tolist())
                rest = table.slice(int(ends[-1]))
            else:
                rest = table
        if rest is not None and len(rest):
            yield tally(rest, [len(rest)])

    found = stage(dealt.mapInArrow(compare, "cid long, n long, to long"), "links")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    labels = components(found.where("cid <> to").select(F.col("cid").alias("a"), F.col("to").alias("b")))
    of = classes.join(counts, "cid", "left").join(labels.withColumnsRenamed({"node": "cid", "component_id": "label"}), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    of = with_least(of, "label", "least", "first").select("digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.col("first.vec_id").alias("component_id"), F.col("first.rid").alias("first_rid"))
    out = rows.select("rid", "vec_id", "digest").join(of, "digest", "left")
    alone = F.col("digest").isNull()
    return out.select("rid", "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("rid") == F.col("first_rid"))).alias("first"))


def report(vectors: DataFrame) -> DataFrame:
    """The digest of query op3."""
    return links(vectors).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
