"""Repeated passages, found at difference-cover anchors.

Word positions of a document are taken modulo 13. The residues 0, 1, 3 and 9 are a difference
cover: for any two positions some shift below 13 puts both on the cover. So two equal windows of
20 words share an anchor, a window of 20 - 13 + 1 = 8 words that starts on the cover in both.

Anchors are hashed and those that repeat anywhere are found. Each is extended to the windows of 20
words around it; windows of one hash are compared across the corpus, and all but the first
(smaller doc_id, then earlier start) are repeats. A repeated window always holds a repeated
anchor, so nothing is missed. Windows are told apart by 96 bits of hash.

Hashes travel as packed arrays. Before they do, each task settles its own repeats and sends one
entry per hash, so a passage in a third of all rows costs one entry per task.

Defined cases: a null, empty or short text has no window; rows of one doc_id count in the order
of the table; a null id is last; other columns are never looked at; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import bounded, key_mark, lent, numbered, stage

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Entries that a task holds before it sends them.
FLUSH = 600_000
LAST_ID = (1 << 63) - 1

_ON_COVER = np.isin(np.arange(PERIOD), COVER)
_COLUMNS = ["key", "more", "doc", "rid", "pos", "known"]
_PACKED = "part int, key binary, more binary, doc binary, rid binary, pos binary, known binary"
_FOUND = "rid long, pos binary"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchors(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a document."""
    at = np.arange(max(0, len(w) - ANCHOR + 1)) if len(w) >= WINDOW else np.zeros(0, np.int64)
    at = at[_ON_COVER[at % PERIOD]]
    return at, wordhash.windows(w, at, ANCHOR)


def around(at: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of a document of n words that hold one of these anchors."""
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, np.maximum(at - (WINDOW - ANCHOR), 0), 1)
    np.add.at(marks, np.minimum(at + 1, n), -1)
    return np.flatnonzero(np.cumsum(marks)[: max(0, n - WINDOW + 1)] > 0)


class _Entries:
    """Entries (key, more, doc, rid, pos) of a task, settled among themselves before they are sent."""

    def __init__(self, first_stays: bool, parts: int):
        self.first_stays, self.parts, self.held, self.n = first_stays, parts, [], 0

    def add(self, key: np.ndarray, more: np.ndarray, doc: int, rid: int, pos: np.ndarray) -> None:
        self.held.append((key, more, np.full(len(key), doc), np.full(len(key), rid), pos.astype(np.uint32)))
        self.n += len(key)

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        key, more, doc, rid, pos = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        order = np.lexsort((pos, rid, doc, more, key)) if self.first_stays else np.lexsort((more, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (more[order][1:] != more[order][:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        again = order[~new] if self.first_stays else order[np.repeat(size > 1, size)]
        sent = order[first]
        known = (size > 1).astype(np.uint8)
        back = np.argsort(sent, kind="stable")  # document order packs better
        sent, known = sent[back], known[back]
        part = (key[sent] % np.uint64(self.parts)).astype(np.int64)
        back = np.argsort(part, kind="stable")
        sent, known, part = sent[back], known[back], part[back]
        ends = np.searchsorted(part, np.arange(self.parts), side="right")
        rows, last = [], 0
        for p, end in enumerate(ends.tolist()):
            if end > last:
                s = sent[last:end]
                rows.append((p, key[s].tobytes(), more[s].tobytes(), doc[s].tobytes(), rid[s].tobytes(), pos[s].tobytes(), known[last:end].tobytes()))
            last = end
        if len(again):  # settled here: passes through
            again = again[np.argsort(again, kind="stable")]
            rows.append((int(rid[again[0]] % self.parts), b"", b"", b"", rid[again].tobytes(), pos[again].tobytes(), b""))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["part", *_COLUMNS])


def _by_bucket(rid: np.ndarray, pos: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Positions packed by bucket of documents: a row per bucket, however many documents there are."""
    if not len(rid):
        return
    bucket = (wordhash.mixed(rid.view(np.uint64) * wordhash.M1) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rid, pos, bucket = rid[order], pos[order], bucket[order]
    cut = np.append(0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1)
    packed = [pa.array([x.tobytes() for x in np.split(y, cut[1:])], pa.binary()) for y in (rid, pos)]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), *packed], ["bucket", "rid", "pos"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document with its positions."""
    held = [(np.frombuffer(r, np.int64), np.frombuffer(p, np.uint32)) for b in batches for r, p in zip(b["rid"].to_pylist(), b["pos"].to_pylist(), strict=True)]
    if not held:
        return
    rid, pos = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(rid, kind="stable")
    rid, pos = rid[order], pos[order]
    cut = np.append(0, np.flatnonzero(rid[1:] != rid[:-1]) + 1)
    for i in range(0, len(cut), 10_000):
        some = cut[i : i + 10_000]
        ends = np.append(some[1:], cut[i + 10_000] if i + 10_000 < len(cut) else len(rid))
        yield pa.RecordBatch.from_arrays([pa.array(rid[some]), pa.array([pos[x:y].tobytes() for x, y in zip(some, ends, strict=True)], pa.binary())], ["rid", "pos"])


def _settle(first_stays: bool, parts: int) -> Callable:
    """Of entries of one hash in a partition: all, or all but the first, unless settled before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.uint32))]
        for batch in batches:
            for key, more, doc, rid, pos, known in zip(*(batch[c].to_pylist() for c in _COLUMNS), strict=True):
                r, p = np.frombuffer(rid, np.int64), np.frombuffer(pos, np.uint32)
                if key:
                    held.append((np.frombuffer(key, np.uint64), np.frombuffer(more, np.uint32), np.frombuffer(doc, np.int64), r, p, np.frombuffer(known, np.uint8)))
                else:
                    done.append((r, p))
        if not held:
            yield from _by_bucket(*(np.concatenate(x) for x in zip(*done, strict=True)), parts)
            return
        key, more, doc, rid, pos, known = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((pos, rid, doc, more, key)) if first_stays else np.lexsort((more, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (more[order][1:] != more[order][:-1])
        if first_stays:
            hit = order[~new]
        else:
            size = np.diff(np.append(np.flatnonzero(new), len(order)))
            hit = order[np.repeat(size > 1, size)]
            hit = hit[known[hit] == 0]
        done.append((rid[hit], pos[hit]))
        yield from _by_bucket(*(np.concatenate(x) for x in zip(*done, strict=True)), parts)

    return run


def _repeats(rows: DataFrame, entries: Callable, first_stays: bool, parts: int) -> DataFrame:
    """(rid, pos): positions that repeat. entries(batch) gives (key, more, doc, rid, pos) per document."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Entries(first_stays, parts)
        with lent(wordhash.WORDS):
            for batch in batches:
                for entry in entries(batch):
                    held.add(*entry)
                    if held.n > FLUSH:
                        yield from held.send()
            yield from held.send()
            held = None

    n = max(1, parts // 4)
    found = rows.mapInArrow(pack, _PACKED).repartition(n, "part").mapInArrow(_settle(first_stays, n), "bucket int, rid binary, pos binary")
    return found.repartition(n, "bucket").mapInArrow(_unpack, _FOUND)


def _positions(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob or b"", np.uint32).astype(np.int64)


def removed_words(n: int, starts: np.ndarray) -> np.ndarray:
    """Mask of the words that these windows cover."""
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + WINDOW, n), -1)
    return np.cumsum(marks)[:n] > 0


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space); with ``spans``, also removed.

    ``removed`` holds the removed stretches as [first word, word after].
    """
    spark = docs.sparkSession
    bounded(spark)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))

    def anchor_entries(batch: pa.RecordBatch):
        for rid, t in zip(batch["rid"].to_pylist(), batch["text"].to_pylist(), strict=True):
            w = words_of(t)
            if len(w) >= WINDOW:
                at, key = anchors(wordhash.hashes(w))
                yield key, np.zeros(len(key), np.uint32), 0, rid, at

    marked = stage(_repeats(rows.select("rid", "text"), anchor_entries, False, parts), "anchors")
    rows = key_mark(rows, "rid", marked, "rid", "maybe")
    some = stage(rows.where("maybe").drop("maybe").join(marked, "rid", "left"), "candidates")

    def window_entries(batch: pa.RecordBatch):
        for rid, doc, t, pos in zip(*(batch[c].to_pylist() for c in ("rid", "doc_id", "text", "pos")), strict=True):
            if pos:
                w = wordhash.hashes(words_of(t))
                at = around(_positions(pos), len(w))
                yield wordhash.windows(w, at, WINDOW), (wordhash.windows(w, at, WINDOW, 1) >> np.uint64(32)).astype(np.uint32), LAST_ID if doc is None else doc, rid, at

    repeats = stage(_repeats(some, window_entries, True, parts), "repeats")
    some = some.drop("pos").join(repeats, "rid", "left")
    rest = rows.where("not maybe").drop("maybe").withColumn("pos", F.lit(None).cast("binary"))
    out = "n_words long, n_removed long, kept string, removed array<struct<first:int,after:int>>"

    @F.pandas_udf(out)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, blobs in batches:
            done = []
            for t, b in zip(texts, blobs, strict=True):
                w, gone = words_of(t), []
                n = len(w)
                if b:
                    mask = removed_words(n, _positions(b))
                    w = [x for x, m in zip(w, mask.tolist(), strict=True) if not m]
                    if spans:
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                        gone = [{"first": int(x), "after": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                done.append((n, n - len(w), b" ".join(w).decode("utf-8", "surrogatepass"), gone))
            yield pd.DataFrame(done, columns=["n_words", "n_removed", "kept", "removed"])

    both = some.select("doc_id", cut("text", "pos").alias("c")).unionByName(rest.select("doc_id", cut("text", "pos").alias("c")))
    return both.select("doc_id", "c.n_words", "c.n_removed", "c.kept", *(["c.removed"] if spans else []))


def report(docs: DataFrame) -> DataFrame:
    """The digest of query op8."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))




ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d WHERE len(w) >= {WINDOW})),
r AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM r),
w AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
k AS (SELECT doc_id, count(*) AS n_kept, string_agg(x, ' ' ORDER BY p) AS kept FROM w ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
