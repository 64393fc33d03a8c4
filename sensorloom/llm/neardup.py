"""MinHash near-duplicates with odd sketches.

A document's set holds its distinct word shingles (of three words by default) as 64-bit hashes.
Documents of equal sets form one class. Each class gets MinHash values: bands of ``ROWS`` of them
form the keys of the candidate search, and all are folded into an odd sketch, a parity bitmap
whose XOR population count estimates the similarity of two sets. Candidates that the sketches
leave open are confirmed on the full sets.

No bucket is expanded into its pairs. Classes that share a band's key meet in its bucket, by their
sketches alone; a bucket of more than ``BLOCK`` is met in all pairs of its blocks. Of each bucket
comes one edge per class at most, to the smallest it is like, and classes that such edges join,
directly or through others, form a coarse group, which no link leaves. A group's classes meet in
blocks again, each full set shipped once per block pair; there a pair is only looked at while its
two classes are in different components, first by its sketches, then on the full sets. One edge
per class comes out, to the smallest of its component.

Defined cases: null and empty texts, and texts of white space, have an empty set, link with
nothing and stay; fewer words than a shingle form one; repeated rows are copies of each
other, and of rows with the same smallest id one stays in ``keep``; a null id sorts last;
other columns pass through ``keep`` untouched.
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

from .common import bounded, components, drop_stage, key_mark, lent, numbered, stage, unused, with_least
from .streams import per_group
from .wordhash import M1, M3, WORDS, hashes, mixed, windows

SHINGLE = 3
PERCENT = 85
#: Rows of a band; the number of bands keeps the chance to miss a pair at the threshold under MISS.
ROWS = 4
MISS = 5e-7
BITS = 512
#: Sketch estimates this much under the similarity asked for, about five standard errors, are no candidates.
MARGIN = 0.19
BLOCK = 1024
#: Groups of more than one block joined by broadcast up to this many rows.
MAX_BROADCAST = 100_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_draw = np.random.default_rng(20240601)
_A = (_draw.integers(0, 1 << 31, 1024, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _draw.integers(0, 1 << 32, 1024, dtype=np.uint32)[:, None]
_P = _draw.integers(0, 1 << 63, 1024, dtype=np.uint64)


def bands_for(percent: int) -> int:
    """20 bands at 85 %, 28 at 80 %."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def samples_for(percent: int) -> int:
    return max(128, ROWS * bands_for(percent))


def most_bits(percent: int) -> int:
    """Most differing sketch bits of a candidate pair: half of BITS * (1 - (1 - 2 / BITS) ** d) at d differing entries."""
    differing = 2 * samples_for(percent) * (1 - (percent / 100 - MARGIN))
    return round(BITS / 2 * (1 - (1 - 2 / BITS) ** differing))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = hashes(words)
    n = max(1, len(w) - size + 1)
    return np.unique(windows(w, np.arange(n), min(size, len(w))))


def minhashes(found: np.ndarray, samples: int) -> np.ndarray:
    """Minima of multiply-add hashes."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(samples, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        least = np.minimum(least, (_A[:samples] * x[None, i : i + 2048] + _B[:samples]).min(axis=1))
    return least


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity bitmap of the (sample, minimum) pairs, as 64-bit words."""
    at = mixed(least.astype(np.uint64) * M1 + _P[: len(least)]) % np.uint64(BITS)
    odd = np.bincount(at.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def estimate(bits: np.ndarray, samples: int) -> np.ndarray:
    """Similarity from differing sketch bits."""
    return 1 + BITS / (4 * samples) * np.log(np.maximum(1 - 2 * bits / BITS, 1e-9))


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64) * M3
    for i in range(ROWS):
        key = mixed(key * M1 + least[i : bands * ROWS : ROWS].astype(np.uint64))
    return key.view(np.int64)


def linked(one: np.ndarray, many: list[np.ndarray], percent: int) -> np.ndarray:
    """100 * intersection >= percent * union with each of many, on the full sets (sorted, distinct)."""
    size = np.array([len(m) for m in many])
    good = (100 * np.minimum(size, len(one)) >= percent * np.maximum(size, len(one))) & (size > 0)
    if not good.any():
        return good
    rest = [m for m, g in zip(many, good, strict=True) if g]
    flat, ends = np.concatenate(rest), np.cumsum(size[good])
    at = np.searchsorted(one, flat)
    at[at == len(one)] = 0
    both = np.add.reduceat(one[at] == flat, ends - size[good], dtype=np.int64)
    good[good] = 100 * both >= percent * (len(one) + size[good] - both)
    return good


def link_block(sketches: np.ndarray, sets: list[np.ndarray] | None, side: np.ndarray, same: bool, percent: int, most: int) -> np.ndarray:
    """Smallest row linked with each row, directly or through others; sides meet unless ``same``.

    Without sets, rows of like sketches count as linked.
    """
    n = len(sketches)
    label = np.arange(n)
    other = np.arange(n) if same else np.flatnonzero(side == 1)
    for i in range(n) if same else np.flatnonzero(side == 0):
        rest = other[other > i] if same else other
        rest = rest[label[rest] != label[i]]
        rest = rest[np.bitwise_count(sketches[rest] ^ sketches[i]).sum(axis=1) <= most]
        if sets is None:
            if len(rest):
                found = np.unique(np.append(label[rest], label[i]))
                label[np.isin(label, found)] = found[0]
            continue
        while len(rest):
            now, rest = rest[:256], rest[256:]
            for j in now[linked(sets[i], [sets[k] for k in now], percent)]:
                a, b = sorted((label[i], label[j]))
                if a != b:
                    label[label == b] = a
            rest = rest[label[rest] != label[i]]
    return label


def signatures(rows: DataFrame, text: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """rid, doc_id, n_shingles, digest (null if the set is empty), bands, sketch of numbered rows."""
    bands, samples = bands_for(percent), samples_for(percent)

    @F.pandas_udf("n long, digest binary, bands array<long>, sketch array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with lent(WORDS):
            for texts in batches:
                rows = []
                for t in texts:
                    h = shingles(t, size)
                    if len(h):
                        least = minhashes(h, samples)
                        rows.append((len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), band_keys(least, bands), odd_sketch(least)))
                    else:
                        rows.append((0, None, None, None))
                yield pd.DataFrame(rows, columns=["n", "digest", "bands", "sketch"])

    rows = rows.select("rid", "doc_id", sign(F.col(text)).alias("s"))
    return rows.select("rid", "doc_id", F.col("s.n").alias("n_shingles"), "s.digest", "s.bands", "s.sketch")


def _in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a key in the block pairs they take part in: bi, bj, side beside the other columns."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    blocks = stage(sizes.select(key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hot")
    if blocks.count() <= MAX_BROADCAST:
        blocks = F.broadcast(blocks)
    out = rows.join(blocks, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    out = out.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.select(*rows.columns, F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), (F.col("block") > F.col("other")).cast("int").alias("side"))


def _links(held: DataFrame, key: str, percent: int) -> DataFrame:
    """Edges (a, b) between classes of one key. held: cid, key, sketch and, to confirm links, set."""
    whole, most = "set" in held.columns, most_bits(percent)

    def run(table) -> list[tuple]:
        n = len(table)
        if n < 2:
            return []
        sketches = np.asarray(table["sketch"].combine_chunks().flatten()).reshape(n, -1).view(np.uint64)
        sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()] if whole else None
        cid, same = table["cid"].to_numpy(), table["bi"][0] == table["bj"][0]
        label = link_block(sketches, sets, table["side"].to_numpy(), same, percent, most)
        return [(int(cid[k]), int(cid[i])) for i, k in enumerate(label) if k != i]

    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return per_group(_in_blocks(held, key), [key, "bi", "bj"], run, "a long, b long", arrow)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """rid, doc_id, n_shingles, component_id, first (the one row of its component that stays)."""
    return _groups(numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "text", percent, size)


def _groups(docs: DataFrame, text: str, percent: int, size: int) -> DataFrame:
    bounded(docs.sparkSession)
    signed = stage(signatures(docs, text, percent, size), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("rid").alias("cid"), F.min(order).alias("least"))
    classes = stage(classes, "classes")
    nodes = signed.join(classes.select(F.col("cid").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("cid"), "bands", "sketch")
    rows = nodes.select("cid", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    member = stage(rows.join(shared, "key").join(nodes.select("cid", "sketch"), "cid"), "buckets")
    alike = _links(member.select("key", "cid", "sketch"), "key", percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    coarse = stage(components(alike).withColumnsRenamed({"node": "cid", "component_id": "coarse"}), "coarse")
    drop_stage(member)
    held = nodes.select("cid", "sketch").join(coarse, "cid").join(_sets(docs, text, size, coarse), "cid")
    links = stage(_links(held, "coarse", percent), "confirmed")
    labels = components(links)
    of = classes.join(labels.withColumnsRenamed({"node": "cid", "component_id": "label"}), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    of = with_least(of.select("digest", "label", "least"), "label", "least", "first").select("digest", F.col("first.doc_id").alias("component_id"), F.col("first.rid").alias("first_rid"))
    out = signed.select("rid", "doc_id", "n_shingles", "digest").join(of, "digest", "left")
    alone = F.col("digest").isNull()
    return out.select("rid", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("rid") == F.col("first_rid"))).alias("first"))


def _sets(docs: DataFrame, text: str, size: int, ids: DataFrame) -> DataFrame:
    """cid, set: the full sets of the classes in coarse groups, and of some others."""

    @F.pandas_udf("binary")
    def full(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with lent(WORDS):
            for texts in batches:
                yield pd.Series([shingles(t, size).tobytes() for t in texts], dtype=object)

    some = docs.select(F.col("rid").alias("cid"), F.col(text).alias("text"))
    return key_mark(some, "cid", ids, "cid", "maybe").where("maybe").select("cid", full("text").alias("set"))


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One document of each group, with its own columns."""
    rid, maybe = unused("rid", docs), unused("maybe", docs)
    rows = numbered(docs, rid)
    slim = rows.select(F.col(rid).alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    gone = stage(_groups(slim, "text", percent, size).where(~F.col("first")).select(F.col("rid").alias(rid)), "gone")
    rows = key_mark(rows, rid, gone, rid, maybe)
    some = rows.where(maybe).join(gone, rid, "left_anti")
    return rows.where(~F.col(maybe)).select(*docs.columns).unionByName(some.select(*docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """The digest of query op6."""
    found = groups(docs)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
