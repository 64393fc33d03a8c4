"""Benchmark decontamination with an Aho-Corasick automaton over normalised benchmark windows.

Benchmark items are cut into windows of ten consecutive words (an item of fewer words is one
window). All windows form one automaton, and every document is scanned once. The windows are
counted first: an automaton holds about ``MAX_WINDOWS`` of them (counted once per item that has
them), and a larger benchmark is scanned in blocks of that size, one after the other, whose hits
are merged by document.

Defined cases: a null or empty text has no words and no hits; an item without words has no
window; equal windows of several items count for each of them; repeated item ids count once;
other columns of the inputs are kept by ``annotate`` and never looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, lent, numbered, stage, unused

WINDOW = 10
#: Windows in one automaton; about 200 MB in a worker.
MAX_WINDOWS = 300_000

#: Bytes: A-Z to a-z, what parts words to a space, the rest as it is.
_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
HITS = "n_words long, hits array<struct<first:int,last:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Normalised words, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows_of(text: str | None, width: int = WINDOW) -> list[str]:
    w = words_of(text)
    n = min(width, len(w))
    return list({b" %b " % b" ".join(w[i : i + n]): 0 for i in range(len(w) - n + 1)}) if n else []


def _windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([[w.decode("utf-8", "surrogatepass") for w in windows_of(x, width)] for x in b], dtype=object)

    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.explode(cut(F.col(text))).alias("window"))
    return rows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def automaton(windows):
    """One automaton over (window, items)."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for window, items in windows:
        machine.add_word(window, (window.count(" ") - 1, items))
    machine.make_automaton()
    return machine


def merged(spans) -> list[tuple[int, int]]:
    """Word spans [first, last], joined where they touch."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def scan(text: str | None, machine) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Words, merged word spans [first, last] that occur in the automaton, and their items."""
    words = words_of(text)
    spans, items = [], set()
    line = (b" %b " % b" ".join(words)).decode("utf-8", "surrogatepass")
    found = list(machine.iter(line)) if words and len(machine) else []
    if found:
        at = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) == 32)
        ends = np.searchsorted(at, [e for e, _ in found]) - 1
        for last, (_, (n, of)) in zip(ends.tolist(), found, strict=True):
            spans.append((last - n + 1, last))
            items.update(of)
    return len(words), merged(spans), sorted(items)


def original_offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as [start, end) code point offsets of the text as it was given."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    point = lambda b: len(raw[:b].decode("utf-8", "surrogatepass"))
    return [(point(places[a][0]), point(places[b][1])) for a, b in spans]


def _row(n: int, spans, items) -> tuple:
    return n, [{"first": int(a), "last": int(b)} for a, b in spans], items


def _scanner(shared):
    @F.pandas_udf(HITS)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with lent():
            machine = automaton(shared.value)
            for texts in batches:
                yield pd.DataFrame([_row(*scan(t, machine)) for t in texts], columns=["n_words", "hits", "items"])

    return hits


def _joined():
    """The hits of one document in several blocks as one."""

    @F.pandas_udf(HITS)
    def hits(parts: pd.Series) -> pd.DataFrame:
        rows = []
        for some in parts:
            spans = merged((x["first"], x["last"]) for p in some for x in p["hits"])
            rows.append(_row(some[0]["n_words"], spans, sorted({i for p in some for i in p["items"]})))
        return pd.DataFrame(rows, columns=["n_words", "hits", "items"])

    return hits


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, out: str = "leak", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Adds the struct column ``out`` (n_words, hits as word spans, items) to every document.

    Blocks are scanned one after the other, each in a job of its own, so one automaton lives at a time.
    """
    spark = docs.sparkSession
    bounded(spark)
    windows = stage(_windows(benchmark, item_id, item_text, width), "windows")
    entries = windows.agg(F.sum(F.size("items"))).first()[0] or 0
    blocks = max(1, -(-entries // max_windows))
    share = lambda df: spark.sparkContext.broadcast([(r["window"], list(r["items"])) for r in df.collect()])
    if blocks == 1:
        return docs.withColumn(out, _scanner(share(windows))(F.col(text)))
    rid = unused("rid", docs)
    docs, found = numbered(docs, rid), None
    for k in range(blocks):
        shared = share(windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k))
        part = docs.select(rid, _scanner(shared)(F.col(text)).alias("_h"))
        part = stage(part if k == 0 else part.where(F.size("_h.hits") > 0), "hits")  # the first block counts every document's words
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    found = found.groupBy(rid).agg(F.collect_list("_h").alias("_h")).select(rid, _joined()("_h").alias(out))
    return docs.join(found, rid).drop(rid)


def spans(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per leaked stretch: doc_id, start, end (code points of the original), items of its document."""
    found = annotate(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, **options)
    found = found.where(F.size("leak.hits") > 0)

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def offsets(texts: pd.Series, hits: pd.Series) -> pd.Series:
        found = [original_offsets(t, [(x["first"], x["last"]) for x in h]) for t, h in zip(texts, hits, strict=True)]
        return pd.Series([[{"start": a, "end": b} for a, b in f] for f in found], dtype=object)

    at = F.explode(offsets(F.col("text"), F.col("leak.hits")))
    return found.select("doc_id", at.alias("at"), F.col("leak.items").alias("items")).select("doc_id", "at.start", "at.end", "items")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with their own columns."""
    leak = unused("leak", docs)
    return annotate(docs, benchmark, out=leak, **options).where(F.size(f"{leak}.hits") == 0).drop(leak)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of query op9."""
    found = annotate(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("leak.hits", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"] + 1)
    return found.select(
        "doc_id",
        F.col("leak.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "leak.items").cast("binary"), 256).alias("items_sha256"),
        (F.size("leak.hits") > 0).alias("contaminated"),
    )


_SQL_WORDS = "regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_SQL_WORDS.format(t='text')}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_SQL_WORDS.format(t='text')}, []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
