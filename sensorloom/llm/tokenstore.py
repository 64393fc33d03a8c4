"""Token ids in a content-addressed store.

Format of a store (a folder in the shared file system):

* ``chunks``: Parquet of (digest, ids). ``ids`` are little-endian unsigned 16-bit token ids
  (32-bit where the vocabulary needs it, see the manifest); ``digest`` is their 16-byte BLAKE2b.
  Every distinct chunk is stored once.
* ``recipes``: Parquet of (doc_id, start, n_tokens, digests, lengths, leaf), the chunks of each
  document in order. Folders shard=0, 1, 2 ... and the rows of each file go in ascending doc_id
  order (null last). ``leaf`` is the SHA-256 of the recipe.
* ``manifest``: one JSON line with the number of documents, ids and chunks, the id width, the
  type of doc_id, and the Merkle root over all leaves.

A document's id stream ends in the end id. Streams are cut where a rolling hash of the last
``SPAN`` ids meets a mask, not before ``LEAST`` and at latest after ``MOST`` ids, so that equal
stretches of different documents give equal chunks. ``verify`` reads the files back, hashes
every chunk and recipe anew and compares them with the digests and the Merkle root.

Ids come from the tokenizers library. Its result for a text is the concatenation of its results
for the pieces between spaces and line ends, so pieces are put together from parts that are
encoded once per worker and remembered (twice ``MAX_CORES`` bytes and the parts of ``AT_ONCE``
pieces at most).

Defined cases: a null or empty text is a stream of the end id alone; rows of equal doc_id follow
each other in the order of their texts' hashes; an empty table gives an empty store; other
columns are not stored.
"""

from __future__ import annotations

import hashlib
import json
import os
import string
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, drop_path, lent, prefix_sums, shared_path, stage

END = 2
SPAN, MASK_BITS, LEAST, MOST = 8, 9, 128, 4096
#: Bytes of one generation of cores and their ids: some 400,000.
MAX_CORES = 12 << 20
#: Pieces that are looked up together, and words that are encoded as one text.
AT_ONCE, GROUP = 1_000_000, 128
#: Ids that are cut into chunks together.
TOGETHER = 100_000
#: Ids in one run of leaves, and runs in one group, of the Merkle tree.
RUN, FAN_IN = 1 << 22, 1 << 12
#: Digests of chunks that a task has sent and need not send again.
MAX_SENT = 100_000

_rng = np.random.default_rng(7)
_GEAR = _rng.integers(0, 1 << 63, 1 << 16, dtype=np.uint64)


NO_CORES, NO_IDS = pa.array([], pa.large_string()), pa.array([], pa.large_binary())


class _Pieces:
    """Ids of pieces between spaces, as bytes.

    A piece is put together from its core and the signs behind it, so that a word is encoded once
    whether a comma follows or not. Cores are remembered in two generations: when one is full,
    the one before is forgotten. A generation is two Arrow arrays, cores and their ids, not a dict
    of Python objects. Words of letters alone are encoded many at a time: each ends in the one id
    that ends a word, which is counted.
    """

    def __init__(self, tokenizer, width: str):
        self.tokenizer, self.width = tokenizer, width
        self.code = {"<u2": "H", "<u4": "I"}[width]
        self.cores, self.ids = NO_CORES, NO_IDS
        self.before: tuple[pa.LargeStringArray, pa.LargeBinaryArray] | None = None
        self.parted = all(self._ids(f"Ab{c}") == self._ids("ab") + self._ids(c) for c in SIGNS)
        suffix, known = getattr(tokenizer.model, "end_of_word_suffix", None), tokenizer.get_vocab()
        self.last = np.zeros(max(known.values(), default=0) + 1, bool)
        if suffix:
            self.last[[i for token, i in known.items() if token.endswith(suffix)]] = True

    def _ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of words, encoded as one text if each is one piece to the vocabulary's rules."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.width)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return [self._ids(w) for w in words]
        raw, ends = ids.tobytes(), (ends * ids.itemsize).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def _new(self, cores: list[str]) -> list[bytes]:
        plain = [c != "" and LAST.issuperset(c) for c in cores]
        words = [c for c, p in zip(cores, plain, strict=True) if p]
        found = chain.from_iterable(self._together(words[k : k + GROUP]) for k in range(0, len(words), GROUP))
        return [next(found) if p else self._ids(c) for c, p in zip(cores, plain, strict=True)]

    def _remember(self, cores: pa.LargeStringArray, ids: pa.LargeBinaryArray) -> None:
        self.cores, self.ids = pa.concat_arrays([self.cores, cores]), pa.concat_arrays([self.ids, ids])

    def many(self, cores: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of each core; no two are equal."""
        if self.cores.nbytes + self.ids.nbytes >= MAX_CORES:
            self.before, self.cores, self.ids = (self.cores, self.ids), NO_CORES, NO_IDS
        new = cores.filter(pc.invert(pc.is_in(cores, value_set=self.cores)))
        if self.before:
            known, ids = self.before
            at = pc.index_in(new, value_set=known)
            self._remember(new.filter(at.is_valid()), ids.take(at.drop_null()))
            new = new.filter(at.is_null())
        self._remember(new, pa.array(self._new(new.to_pylist()), pa.large_binary()))
        return self.ids.take(pc.index_in(cores, value_set=self.cores))


#: Latin letters whose lower case is one letter; the classes of rarer signs may differ from one library to another.
LAST = frozenset(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1)
#: ASCII signs; the one that begins a special token is not among them.
SIGNS = string.punctuation.replace("<", "")
_IS_LAST, _IS_SIGN = np.isin(np.arange(0x800), list(map(ord, LAST))), np.isin(np.arange(0x100), list(map(ord, SIGNS)))


def parts(pieces: pa.LargeStringArray) -> pa.LargeStringArray:
    """Core of each piece and the signs behind it in turn, which the vocabulary's own rules always tell apart from a letter; ASCII cores in lower case.

    Pieces that may hold a special token stay whole.
    """
    places = np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1]
    data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[: places[-1]]
    starts, ends = places[:-1], places[1:]
    signless = np.append(0, np.maximum.accumulate(np.where(_IS_SIGN[data], 0, np.arange(1, len(data) + 1))))
    cut = signless[ends]
    padded = np.append(np.zeros(2, np.uint8), data).astype(np.int16)
    last, prior = padded[cut + 1], padded[cut]
    letter = np.where(last < 0x80, last, np.where(prior >> 5 == 6, (prior & 31) << 6 | last & 63, 0))  # of one or two bytes
    split = (cut > starts) & _IS_LAST[letter]
    split[np.searchsorted(ends, np.flatnonzero(data == ord("<")), "right")] = False
    both = np.zeros(2 * len(pieces) + 1, np.int64)
    both[1::2], both[2::2] = np.where(split, cut, ends), ends
    out = pa.LargeStringArray.from_buffers(2 * len(pieces), pa.py_buffer(both), pa.py_buffer(data))
    plain = pc.and_not(pc.string_is_ascii(out), pc.match_substring(out, "<"))
    return pc.if_else(plain, pc.ascii_lower(out), out)


def parted(piece: str) -> tuple[str, str]:
    """Core of one piece and the signs behind it."""
    return tuple(parts(pa.array([piece], pa.large_string())).to_pylist())


_LOADED: dict[tuple[str, str], _Pieces] = {}


def _pieces(path: str, width: str) -> _Pieces:
    if (path, width) not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path, width] = _Pieces(Tokenizer.from_file(path), width)
    return _LOADED[path, width]


def encode(text: str | None, pieces: _Pieces, end: int = END) -> np.ndarray:
    """The ids of a text and the end id."""
    return encode_all([text], pieces, end)[0]


def encode_all(texts: Iterable[str | None], pieces: _Pieces, end: int = END) -> list[np.ndarray]:
    """The ids of each text and the end id.

    Pieces are told apart in the texts' bytes, and each run of ``AT_ONCE`` pieces is looked up once per distinct piece.
    """
    rows = pa.array([f"{t or ''} " for t in texts], pa.large_string())
    if not len(rows):
        return []
    stops = np.frombuffer(rows.buffers()[1], np.int64)[1 : len(rows) + 1]
    data = np.frombuffer(rows.buffers()[2], np.uint8)[: stops[-1]]
    apart = (data == ord(" ")) | (data == ord("\n"))
    at = np.flatnonzero(apart)
    places = np.append(0, at - np.arange(len(at)))
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(places), pa.py_buffer(data[~apart]))
    flat, sizes = [], [np.zeros(1, np.int64)]
    for k in range(0, len(words), AT_ONCE):
        run = words.slice(k, AT_ONCE).dictionary_encode()
        each = (parts(run.dictionary) if pieces.parted else run.dictionary).dictionary_encode()
        got = pieces.many(each.dictionary).take(each.indices)
        if pieces.parted:  # core and signs are one piece again
            both = np.frombuffer(got.buffers()[1], np.int64)[: len(got) + 1 : 2].copy()
            got = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(both) - 1, [None, pa.py_buffer(both), got.buffers()[2]])
        got = got.take(run.indices)
        ends = np.frombuffer(got.buffers()[1], np.int64)[: len(got) + 1]
        flat.append(np.frombuffer(got.buffers()[2] or b"", np.uint8)[: ends[-1]].view(pieces.width))
        sizes.append(np.diff(ends))
    ids = np.concatenate(flat)
    ends = np.cumsum(np.concatenate(sizes))[np.searchsorted(at, stops)] // ids.itemsize
    return np.split(np.insert(ids, ends, end), (ends + np.arange(1, len(ends) + 1))[:-1])


def marks(ids: np.ndarray) -> np.ndarray:
    """Places behind which a chunk may end: where the rolling hash of the last SPAN ids meets the mask."""
    g = _GEAR[ids & 0xFFFF]
    h = g.copy()
    for k in range(1, SPAN):
        h[k:] += g[:-k] << np.uint64(k)
    return np.flatnonzero((h >> np.uint64(40)) & np.uint64((1 << MASK_BITS) - 1) == 0) + 1


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream."""
    return cuts_at(marks(ids).tolist(), 0, len(ids)) if len(ids) > LEAST else [len(ids)]


def cuts_at(places: list[int], first: int, after: int) -> list[int]:
    """Ends of the chunks of the stream ids[first:after] among marked places; none is near enough to its start to depend on the ids before."""
    out, last = [], first
    i = bisect_left(places, first + LEAST)
    while after - last > LEAST:
        i = bisect_left(places, last + LEAST, i)
        last = min(places[i] if i < len(places) else after, last + MOST, after)
        out.append(last - first)
    if last < after:
        out.append(after - first)
    return out


def digest(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


def leaf(doc_id, n_tokens: int, digests: list[bytes]) -> bytes:
    return hashlib.sha256(f"{doc_id}\0{n_tokens}\0".encode() + b"".join(digests)).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node moves up, no leaf gives the hash of nothing."""
    while len(leaves) > 1:
        up = [hashlib.sha256(a + b).digest() for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = up + leaves[len(up) * 2 :]
    return leaves[0] if leaves else hashlib.sha256(b"").digest()


def write(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = END, width: str = "<u2", path: str | None = None) -> str:
    """Writes a store and returns its folder."""
    spark = docs.sparkSession
    bounded(spark)
    path = path or shared_path(spark, "store")

    @F.pandas_udf("n_tokens long, digests array<binary>, lengths array<int>, fresh array<binary>")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces, sent = _pieces(tokenizer, width), set()
        with lent():
            for texts in batches:
                rows, streams, size = [], [], 0
                for ids in encode_all(texts, pieces, end):
                    streams.append(ids)
                    size += len(ids)
                    if size > TOGETHER:
                        rows += packed(streams, sent)
                        streams, size = [], 0
                if streams:
                    rows += packed(streams, sent)
                yield pd.DataFrame(rows, columns=["n_tokens", "digests", "lengths", "fresh"])

    def packed(streams: list[np.ndarray], sent: set) -> list[tuple]:
        flat = np.concatenate(streams)
        raw, size, places, at, rows = memoryview(flat.tobytes()), flat.itemsize, marks(flat).tolist(), 0, []
        for ids in streams:
            digests, lengths, fresh, last = [], [], [], at
            for e in cuts_at(places, at, at + len(ids)):
                part = bytes(raw[last * size : (at + e) * size])
                d = digest(part)
                digests.append(d)
                lengths.append(at + e - last)
                if d in sent:
                    fresh.append(None)
                else:  # later copies in this task need not send it again
                    if len(sent) > MAX_SENT:
                        sent.clear()
                    sent.add(d)
                    fresh.append(part)
                last = at + e
            rows.append((len(ids), digests, lengths, fresh))
            at += len(ids)
        return rows

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("tie"), pack(F.col(text)).alias("p"))
    rows.select("doc_id", "tie", "p.*").write.option("compression", "zstd").parquet(f"{path}/staged")
    staged = spark.read.parquet(f"{path}/staged")
    chunks = staged.select(F.explode(F.arrays_zip(F.col("digests").alias("digest"), F.col("fresh").alias("ids"))).alias("c")).select("c.*")
    chunks.where("ids is not null").groupBy("digest").agg(F.first("ids").alias("ids")).write.option("compression", "zstd").parquet(f"{path}/chunks")

    @F.pandas_udf("binary")
    def leaves(ids: pd.Series, n: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series([leaf(None if pd.isna(i) else i, k, [bytes(x) for x in d]) for i, k, d in zip(ids, n, digests, strict=True)], dtype=object)

    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    recipes = prefix_sums(staged.select("doc_id", "tie", "n_tokens", "digests", "lengths"), order, "n_tokens", "start", part="shard")
    recipes = recipes.withColumn("leaf", leaves(F.col("doc_id").cast("string"), F.col("n_tokens"), F.col("digests")))
    recipes.select("doc_id", "tie", "start", "n_tokens", "digests", "lengths", "leaf", "shard").sortWithinPartitions("shard", "start").write.partitionBy("shard").parquet(f"{path}/recipes")
    drop_path(spark, f"{path}/staged")
    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    found = _roots(spark, path, kind)
    counts = _recipes(spark, path, kind).agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    manifest = {"documents": counts[0], "ids": counts[1] or 0, "chunks": spark.read.parquet(f"{path}/chunks").count(), "width": width, "end": end, "doc_id": kind, "root": found}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return path


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def _recipes(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    kind = kind or manifest(spark, path)["doc_id"]
    schema = f"doc_id {kind}, tie long, start long, n_tokens long, digests array<binary>, lengths array<int>, leaf binary, shard int"
    return spark.read.schema(schema).parquet(f"{path}/recipes")


def _roots(spark: SparkSession, path: str, kind: str | None = None) -> str:
    """Merkle root of the leaves in the recipe files, in the order of their starts.

    Leaves meet in fixed runs of RUN ids, and runs in groups of FAN_IN, until one is left: no task
    holds a whole shard, and the driver one root.
    """

    def root(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place", kind="stable")
        return pd.DataFrame({"place": frame["run"].iloc[:1], "root": [merkle([bytes(x) for x in frame["root"]])]})

    rows, fan = _recipes(spark, path, kind).select(F.col("start").alias("place"), F.col("leaf").alias("root")), RUN
    top = rows.agg(F.max("place")).first()[0]
    if top is None:
        return merkle([]).hex()
    while True:
        found = rows.withColumn("run", F.floor(F.col("place") / fan)).groupBy("run").applyInPandas(root, "place long, root binary")
        top, fan = top // fan, FAN_IN
        if not top:
            return bytes(found.first()["root"]).hex()
        rows = stage(found, "roots")


def _crc_powers(count: int = 40) -> list[int]:
    """x ** (8 * 2 ** k) modulo the CRC-32 polynomial, bits reflected."""
    x = 1 << 30  # x ** 1
    for _ in range(3):
        x = _times(x, x)
    out = [x]
    for _ in range(count - 1):
        out.append(_times(out[-1], out[-1]))
    return out


def _times(a, b):
    """Product modulo the CRC-32 polynomial; numbers or arrays of them."""
    out = a * 0 + b * 0
    for i in range(31, -1, -1):
        out = out ^ ((a >> i & 1) * b)
        b = (b >> 1) ^ ((b & 1) * 0xEDB88320)
    return out


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files of a store.

    Each stored chunk is read, checked against its digest, and gives the CRC-32 of its ids as
    32-bit integers; a document's CRC-32 is combined from those of its chunks.
    """
    width = manifest(spark, path)["width"]

    @F.pandas_udf("crc long, n int, good boolean")
    def sums(digests: pd.Series, ids: pd.Series) -> pd.DataFrame:
        out = []
        for d, raw in zip(digests, ids, strict=True):
            wide = np.frombuffer(raw, width).astype("<u4")
            out.append((zlib.crc32(wide.tobytes()), len(wide), digest(raw) == d))
        return pd.DataFrame(out, columns=["crc", "n", "good"])

    chunks = spark.read.parquet(f"{path}/chunks").select("digest", sums("digest", "ids").alias("s")).select("digest", "s.crc", F.when(F.col("s.good"), F.col("s.n")).alias("n"))
    recipes = _recipes(spark, path).select("doc_id", "tie", "start", "n_tokens", F.monotonically_increasing_id().alias("row"), "digests")
    parts = recipes.select("row", F.posexplode("digests").alias("at", "digest")).join(chunks, "digest", "left")
    ends = parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "crc", "n"))).alias("parts"))

    @F.pandas_udf("crc long, n long")
    def joined(parts: pd.Series) -> pd.DataFrame:
        powers = _crc_powers()
        counts = np.array([len(p) for p in parts])
        crc = np.array([x["crc"] if x["crc"] is not None else 0 for p in parts for x in p], np.int64)
        n = np.array([x["n"] if x["n"] is not None else -1 for p in parts for x in p], np.int64)
        if (n < 0).any():
            raise ValueError("a chunk is missing or damaged")
        ends = np.cumsum(counts)
        total = np.add.reduceat(n, ends - counts)
        after = np.repeat(np.cumsum(n)[ends - 1], counts) - np.cumsum(n)  # ids behind each chunk
        left, k = after * 4, 0
        while left.any():
            odd = (left & 1) == 1
            crc[odd] = _times(crc[odd], np.int64(powers[k]))
            left, k = left >> 1, k + 1
        return pd.DataFrame({"crc": np.bitwise_xor.reduceat(crc, ends - counts), "n": total})

    found = ends.select("row", joined("parts").alias("j"))
    rows = recipes.drop("digests").join(found, "row")
    return rows.select("doc_id", "start", F.col("j.n").alias("n_tokens"), F.col("j.crc").alias("ids_crc32"))


def verify(spark: SparkSession, path: str) -> dict:
    """Counts of what doesn't agree with the digests, recipes and Merkle root of a store."""
    known = manifest(spark, path)

    @F.pandas_udf("boolean")
    def bad(digests: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([digest(raw) != d for d, raw in zip(digests, ids, strict=True)])

    @F.pandas_udf("boolean")
    def wrong(ids: pd.Series, n: pd.Series, digests: pd.Series, leaves: pd.Series) -> pd.Series:
        return pd.Series([leaf(None if pd.isna(i) else i, k, [bytes(x) for x in d]) != have for i, k, d, have in zip(ids, n, digests, leaves, strict=True)])

    chunks, recipes = spark.read.parquet(f"{path}/chunks"), _recipes(spark, path)
    missing = recipes.select(F.explode("digests").alias("digest")).distinct().join(chunks.select("digest"), "digest", "left_anti")
    return {
        "damaged_chunks": chunks.where(bad("digest", "ids")).count(),
        "missing_chunks": missing.count(),
        "wrong_recipes": recipes.where(wrong(F.col("doc_id").cast("string"), "n_tokens", "digests", "leaf")).count(),
        "root_differs": int(_roots(spark, path) != known["root"]),
    }


def decode_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array of int): the documents rebuilt from the files."""
    width = manifest(spark, path)["width"]
    recipes = _recipes(spark, path).select("doc_id", "start", F.monotonically_increasing_id().alias("row"), F.posexplode("digests").alias("at", "digest"))
    parts = recipes.join(spark.read.parquet(f"{path}/chunks"), "digest")
    rows = parts.groupBy("row", "doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))

    @F.pandas_udf("array<int>")
    def ids(parts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b"".join(x["ids"] for x in p), width).astype(np.int32) for p in parts], dtype=object)

    return rows.select("doc_id", "start", ids("parts").alias("ids"))


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The digest of query op1."""
    return read_back(docs.sparkSession, write(docs, tokenizer))
