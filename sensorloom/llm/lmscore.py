"""Language-model scores by prediction by partial matching (PPM) over bytes.

The training documents give the count of every byte behind every context of ``ORDER`` bytes
(text lower-cased in A-Z, led and ended by the byte 0xFF, which UTF-8 never holds). The suffixes
of these contexts are the shorter contexts of the trie. A byte is coded in its longest known
context: with n of N occurrences and u distinct bytes there, its probability is (2n - 1) / 2N and
that of an escape u / 2N. After an escape the next shorter context counts without the bytes of
the longer ones (symbol exclusion); below the empty context the rest of the 256 bytes is uniform.
A text's score is the sum of the log10 probabilities of its bytes and its end.

The trie is broadcast in blocks of at most ``MAX_GRAMS`` entries, one after the other. Contexts are
told apart by their last byte, then, where one byte's branch is too large, by the byte before it,
and so on; so a block holds whole branches, with the few counts of the contexts above them. A
block's arrays are made once, on the driver; a worker only looks into them.

The base score is that of smoothed word counts. The counts of the most frequent words
(``HEAD`` at most) are broadcast; the other words of a document meet their counts in a join.

Counts travel packed: a task sends one row of sorted counts per partition, not one per count.

Defined cases: a null or empty text is its end alone; the training fold may be empty (then every
byte is uniform and no word is known); repeated rows are scored alike; a null id hashes as the
empty text; other columns are never looked at.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import bounded, fold, lent, numbered, stage

ORDER = 5
MAX_GRAMS = 4_000_000
HEAD = 600_000
FOLDS, HELD_OUT = 5, 1
END = 0xFF
#: The end token of the base score; no word holds a line end.
END_WORD = b"\n"
#: Bytes of text that are looked at together, and counts that a task holds before it merges or sends them.
CHUNK, FLUSH, MOST_WORDS = 1 << 19, 2_000_000, 300_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CTX = np.uint64(8)


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def slices(text: bytes, order: int = ORDER) -> Iterator[bytes]:
    """A text between its lead and its end, in overlapping slices of at most CHUNK + ``order`` bytes."""
    whole = bytes([END]) * order + text + bytes([END])
    for i in range(0, len(text) + 1, CHUNK):
        yield whole[i : i + CHUNK + order]


def codes_of(parts: list[bytes], order: int = ORDER) -> np.ndarray:
    """Codes of (context, byte) for every byte of the slices but the first ``order`` of each."""
    flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    code = np.zeros(max(0, len(flat) - order), np.uint64)
    for i in range(order + 1):
        code = (code << _CTX) | flat[i : len(flat) - order + i]
    inside = np.ones(len(flat), bool)
    ends = np.cumsum([len(p) for p in parts])
    inside[(ends[:, None] - 1 - np.arange(order)).ravel()] = False
    return code[inside[: len(code)]]


def grams_of(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (context, byte) for every byte and end of the texts, and the number of each text's."""
    codes = [codes_of([s], order) for t in texts for s in slices(t, order)]
    return np.concatenate(codes), np.array([len(t) + 1 for t in texts])


def together(texts: list[bytes], order: int = ORDER) -> Iterator[tuple[list[int], list[bytes]]]:
    """Slices of about CHUNK bytes in all, with the texts they are of."""
    at, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for s in slices(t, order):
            at.append(i)
            parts.append(s)
            size += len(s)
            if size >= CHUNK:
                yield at, parts
                at, parts, size = [], [], 0
    if parts:
        yield at, parts


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Trie:
    """Counts of bytes by context, for contexts of 0 to ``order`` bytes.

    Of each length: sorted codes (context, byte) and counts; of the longest, the log10
    probabilities too. ``above`` gives the lengths that the grams don't have whole, the counts of
    single bytes at least.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, above: np.ndarray, order: int = ORDER):
        seen = np.flatnonzero(above).astype(np.uint64), above[above > 0]
        self.order, self.levels = order, [seen, *(self.level(grams, counts, k) for k in range(1, order + 1))]
        self._finish()

    @staticmethod
    def level(grams: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return summed(grams & np.uint64((1 << 8 * (k + 1)) - 1), counts)

    @classmethod
    def of(cls, levels: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
        made = cls.__new__(cls)
        made.order, made.levels = len(levels) - 1, levels
        made._finish()
        return made

    def _finish(self) -> None:
        keys, n = self.levels[-1]
        context = keys >> _CTX
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
        total = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(keys)))) if len(keys) else n
        self.top = np.log10((2 * n - 1) / (2 * np.maximum(total, 1))).astype(np.float32)
        self.levels = [(k, np.minimum(n, 0xFFFFFFFF).astype(np.uint32)) for k, n in self.levels]

    def escaped(self, grams: np.ndarray) -> np.ndarray:
        """log10 probabilities of bytes that their longest contexts have not seen."""
        m, byte = len(grams), (grams & np.uint64(255)).astype(np.int64)
        log, out, left = np.zeros(m), np.zeros((m, 256), bool), np.ones(m, bool)
        for k in range(self.order, -1, -1):
            keys, n = self.levels[k]
            at = np.flatnonzero(left)
            low = ((grams[at] >> _CTX) & np.uint64((1 << 8 * k) - 1)) << _CTX
            a, b = np.searchsorted(keys, low), np.searchsorted(keys, low + np.uint64(256))
            size = b - a
            row = np.repeat(at, size)
            place = np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)
            sign = (keys[place] & np.uint64(255)).astype(np.int64)
            new = ~out[row, sign]
            row, sign, count = row[new], sign[new], n[place[new]].astype(np.float64)
            total, kinds = np.bincount(row, weights=count, minlength=m), np.bincount(row, minlength=m)
            mine = np.zeros(m)
            mine[row[sign == byte[row]]] = count[sign == byte[row]]
            found, lost = mine > 0, (kinds > 0) & (mine == 0)
            log[found] += np.log10((2 * mine[found] - 1) / (2 * total[found]))
            log[lost] += np.log10(kinds[lost] / (2 * total[lost]))
            left &= ~found
            out[row, sign] = True
        log[left] -= np.log10(256 - out[left].sum(1))
        return log

    def logs(self, grams: np.ndarray) -> np.ndarray:
        some, back = np.unique(grams, return_inverse=True)
        keys = self.levels[-1][0]
        at = np.searchsorted(keys, some)
        at[at == len(keys)] = 0
        known = keys[at] == some if len(keys) else np.zeros(len(some), bool)
        logs = np.zeros(len(some))
        logs[known] = self.top[at[known]]
        rest = np.flatnonzero(~known)
        for i in range(0, len(rest), 4096):
            logs[rest[i : i + 4096]] = self.escaped(some[rest[i : i + 4096]])
        return logs[back]


def _dealt(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each part's entries, in their order."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1])) if len(part) else []
    for some in np.split(order, cut[1:]) if len(part) else []:
        yield int(part[some[0]]), some


def train_grams(rows: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """(gram, n): counts of (context, byte) over the texts."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sent(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        dealt = [(p, k[s].tobytes(), n[s].tobytes()) for p, s in _dealt((wordhash.mixed(k * wordhash.M1) % np.uint64(parts)).astype(np.int32))]
        p, k, n = zip(*dealt, strict=True) if dealt else ((), (), ())
        return _batch(part=pa.array(p, pa.int32()), gram=pa.array(k, pa.binary()), n=pa.array(n, pa.binary()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        with lent():
            for batch in batches:
                for _, some in together([lowered(t) for t in batch[text].to_pylist()], order):
                    held.append(np.unique(codes_of(some, order), return_counts=True))
                    if sum(len(k) for k, _ in held) > FLUSH:
                        held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                        if len(held[0][0]) > FLUSH // 2:
                            yield sent(*held.pop())
            if held:
                yield sent(*summed(*map(np.concatenate, zip(*held, strict=True))))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        with lent():
            for batch in batches:
                for k, n in zip(batch["gram"].to_pylist(), batch["n"].to_pylist(), strict=True):
                    held.append((np.frombuffer(k, np.uint64), np.frombuffer(n, np.int64)))
                if sum(len(k) for k, _ in held) > FLUSH:
                    held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
            if held:
                k, n = summed(*map(np.concatenate, zip(*held, strict=True)))
                yield _batch(gram=k.view(np.int64), n=n)

    packed = rows.select(text).mapInArrow(count, "part int, gram binary, n binary").repartition(parts, "part")
    return packed.mapInArrow(merge, "gram long, n long")


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def train_words(rows: DataFrame, text: str = "text") -> DataFrame:
    """(word, c): counts of the words and of the end token."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sent(seen: Counter) -> pa.RecordBatch:
        words, n = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
        dealt = [(p, b" ".join([words[i] for i in s]), n[s].tobytes()) for p, s in _dealt(np.array([zlib.crc32(w) % parts for w in words], np.int32))]
        p, w, c = zip(*dealt, strict=True)
        return _batch(part=pa.array(p, pa.int32()), words=pa.array(w, pa.binary()), c=pa.array(c, pa.binary()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        with lent(seen):
            for batch in batches:
                for t in batch[text].to_pylist():
                    seen.update(lowered(t).split())
                    seen[END_WORD] += 1
                    if len(seen) > MOST_WORDS:
                        yield sent(seen)
                        seen.clear()
            if seen:
                yield sent(seen)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        with lent(seen):
            for batch in batches:
                for words, c in zip(batch["words"].to_pylist(), batch["c"].to_pylist(), strict=True):
                    for w, n in zip(words.split(b" "), np.frombuffer(c, np.int64).tolist(), strict=True):
                        seen[w] = seen.get(w, 0) + n
            if seen:
                yield _batch(word=pa.array(list(seen), pa.binary()), c=list(seen.values()))

    packed = rows.select(text).mapInArrow(count, "part int, words binary, c binary").repartition(parts, "part")
    return packed.mapInArrow(merge, "word binary, c long")


class Branches:
    """How contexts are dealt to blocks: by their last byte, and further back where a branch is too large.

    ``nodes`` holds, for (length, context) of every divided branch, the block of each byte before it
    (-1: divided itself; a byte never seen there goes with another of the branch) and its counts.
    """

    def __init__(self, grams: DataFrame, order: int, max_grams: int):
        self.grams, self.order, self.nodes, leaves = grams, order, {}, []
        self._divide(0, 0, max_grams, leaves)
        self.blocks: list[list[tuple[int, int]]] = [[]]
        room = max_grams
        for size, length, code in sorted(leaves, reverse=True):
            if self.blocks[-1] and size > room:
                self.blocks.append([])
                room = max_grams
            room -= size
            self.blocks[-1].append((length, code))
        for b, held in enumerate(self.blocks):
            for length, code in held:
                self.nodes[length - 1, code & ((1 << 8 * (length - 1)) - 1)][0][code >> 8 * (length - 1)] = b
        for block, _ in self.nodes.values():
            block[block == -2] = block[block >= 0][0] if (block >= 0).any() else -1
        for block, _ in self.nodes.values():  # bytes never seen before a branch whose known ones are all divided
            block[block == -2] = 0

    def _divide(self, length: int, code: int, most: int, leaves: list) -> None:
        here = self.grams if not length else self.grams.where(_context(length) == code)
        rows = here.groupBy(_byte(length + 1).alias("before"), _byte(0).alias("byte")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect()
        counts, sizes, block = np.zeros(256, np.int64), np.zeros(256, np.int64), np.full(256, -2)
        for r in rows:
            counts[r["byte"]] += r["n"]
            sizes[r["before"]] += r["k"]
        self.nodes[length, code] = block, counts
        for x in np.flatnonzero(sizes).tolist():
            mine = code | x << 8 * length
            if sizes[x] > most and length + 1 < self.order:
                block[x] = -1
                self._divide(length + 1, mine, most, leaves)
            else:
                leaves.append((int(sizes[x]), length + 1, mine))

    def levels(self, b: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Codes and counts of every context length that block ``b`` needs."""
        held, whole = self.blocks[b], None
        for length in sorted({n for n, _ in held}):
            some = _context(length).isin([c for n, c in held if n == length])
            whole = some if whole is None else whole | some
        got = (self.grams.where(whole) if whole is not None else self.grams.limit(0)).toArrow()
        grams, n = got["gram"].to_numpy().view(np.uint64), got["n"].to_numpy()
        depth = np.zeros(len(grams), np.int64)
        for length in {n for n, _ in held}:
            codes = np.array([c for x, c in held if x == length], np.uint64)
            depth[np.isin((grams >> _CTX) & np.uint64((1 << 8 * length) - 1), codes)] = length
        above = {(0, 0)} | {(k, c & ((1 << 8 * k) - 1)) for length, c in held for k in range(length)}
        out = []
        for k in range(self.order + 1):
            use = depth <= k
            rows = [Trie.level(grams[use], n[use], k)] if k else []
            for length, code in sorted(above):
                if length == k:
                    counts = self.nodes[length, code][1]
                    rows.append((np.uint64(code << 8) | np.flatnonzero(counts).astype(np.uint64), counts[counts > 0]))
            out.append(summed(*map(np.concatenate, zip(*rows, strict=True))))
        return out

    def owner(self, grams: np.ndarray) -> np.ndarray:
        """The block that scores each gram."""
        context, out = grams >> _CTX, np.full(len(grams), -1)
        for length, code in sorted(self.nodes):
            at = np.flatnonzero((out < 0) & ((context & np.uint64((1 << 8 * length) - 1)) == np.uint64(code)))
            out[at] = self.nodes[length, code][0][((context[at] >> np.uint64(8 * length)) & np.uint64(255)).astype(np.int64)]
        return out


def _byte(back: int) -> Column:
    """The byte ``back`` places before a gram's last."""
    return F.pmod(F.shiftright("gram", 8 * back), F.lit(256)).cast("int")


def _context(length: int) -> Column:
    """The last ``length`` bytes of a gram's context."""
    return F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * length) - 1))


def ppm_scorer(levels, dealt, block: int, order: int):
    """A function from texts to the sums of the log10 probabilities of the bytes that ``block`` scores."""

    def score(texts: list[bytes], trie: Trie) -> np.ndarray:
        out = np.zeros(len(texts))
        for at, parts in together(texts, order):
            grams = codes_of(parts, order)
            if dealt is None:
                logs = trie.logs(grams)
            else:
                logs, use = np.zeros(len(grams)), dealt.value.owner(grams) == block
                logs[use] = trie.logs(grams[use])
            ends = np.cumsum([len(p) - order for p in parts])
            sums = np.add.reduceat(logs, np.append(0, ends[:-1]))
            out += np.bincount(at, weights=sums, minlength=len(texts))
        return out

    return lambda: Trie.of(levels.value), score


def _head(words: DataFrame, head: int):
    """Broadcast counts of the most frequent words, at most ``head`` of them."""
    levels = {r["l"]: r["count"] for r in words.groupBy(F.floor(F.log2("c")).cast("int").alias("l")).count().collect()}
    total, least = 0, 64
    for level in sorted(levels, reverse=True):
        if total + levels[level] > head:
            break
        total, least = total + levels[level], level
    got = words.where(F.col("c") >= 2**least).toArrow() if least < 63 else None
    counts = dict(zip(got["word"].to_pylist(), got["c"].to_pylist(), strict=True)) if got is not None else {}
    return words.sparkSession.sparkContext.broadcast(counts)


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: int = HELD_OUT, order: int = ORDER, head: int = HEAD, max_grams: int = MAX_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    bounded(spark)
    out_of = fold(F.col("doc_id"), FOLDS) == held_out
    rows = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    train = rows.where(~out_of)
    grams = stage(train_grams(train, order=order), "grams")
    words = stage(train_words(train), "words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    known, branches = _head(words, head), Branches(grams, order, max_grams)
    branches.grams, source = None, grams  # what is sent needs no table
    dealt = spark.sparkContext.broadcast(branches) if len(branches.blocks) > 1 else None

    def levels(b: int):
        branches.grams = source
        try:
            return spark.sparkContext.broadcast(branches.levels(b))
        finally:
            branches.grams = None

    def both(shared):
        load, score = ppm_scorer(shared, dealt, 0, order)

        @F.pandas_udf("n_tokens long, n_known long, logs double, tail array<binary>, score double")
        def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            trie, seen = load(), known.value.get
            with lent():
                for batch in batches:
                    texts = [lowered(t) for t in batch]
                    done = []
                    for t, ppm in zip(texts, score(texts, trie).tolist(), strict=True):
                        w = [*t.split(), END_WORD]
                        c = np.fromiter((seen(x, 0) for x in w), np.int64, len(w))
                        hit = c > 0
                        done.append((len(w), int(hit.sum()), float(np.log10(c[hit] + 0.5).sum()), [w[i] for i in np.flatnonzero(~hit)], ppm))
                    yield pd.DataFrame(done, columns=["n_tokens", "n_known", "logs", "tail", "score"])

        return measure

    def bytes_only(shared, b: int):
        load, score = ppm_scorer(shared, dealt, b, order)

        @F.pandas_udf("double")
        def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trie = load()
            with lent():
                for batch in batches:
                    yield pd.Series(score([lowered(t) for t in batch], trie))

        return measure

    shared = levels(0)
    made = rows.select("rid", "doc_id", out_of.alias("held_out"), both(shared)("text").alias("w"))
    made = stage(made.select("rid", "doc_id", "held_out", "w.*"), "scored")
    for used in (shared, known):
        used.unpersist()
    more = None
    for b in range(1, len(branches.blocks)):
        shared = levels(b)
        part = stage(rows.select("rid", bytes_only(shared, b)("text").alias("more")), "block")
        shared.unpersist()
        more = part if more is None else more.unionByName(part)
    if more is not None:
        made = made.join(more.groupBy("rid").agg(F.sum("more").alias("more")), "rid").withColumn("score", F.col("score") + F.col("more")).drop("more")
    tail = made.select("rid", F.explode("tail").alias("word")).groupBy("rid", "word").agg(F.count(F.lit(1)).alias("k"))
    tail = tail.join(words, "word", "left").groupBy("rid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("more"),
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("tail_logs"),
    )
    both_scores = made.drop("tail").join(tail, "rid", "left")
    per_token = math.log10(n + 0.5 * (v + 1))
    return both_scores.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("tail_logs", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"),
        "score",
    )


def report(docs: DataFrame) -> DataFrame:
    """The digest of query op4."""
    return scores(docs)
