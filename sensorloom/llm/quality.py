"""Quality classifier: naive Bayes support vectors over n-gram indicators of words and word shapes.

A text becomes a sequence of word shapes: letters fold to X (upper case), x (other), digits to 9,
runs of one class to one sign, punctuation stays, and a word equal to the one before it is
marked. Its shape n-grams (n = 1 to 3) are one block of indicators; its words and pairs of words, in
lower case, and its character n-grams (n = 2 and 3) are another, hashed to ``BUCKETS`` places. The
indicators are scaled by the log-count ratio of the classes, each block to its own length, and feed
a linear hinge-loss model, fitted by dual coordinate descent. The margin becomes a score by a
logistic curve fitted on the same rows.

Fitting takes at most ``MAX_ROWS`` labelled rows of each class (those with the smallest hash of
their id) and, of each block, the ``MAX_FEATURES`` indicators found in most of them; scoring covers
every row and whole texts.

Defined cases: a null or empty text has no n-grams and gets the score of the intercept; labels
that are null, or of documents that are absent, are not used; of repeated labels the larger
counts; with labels of one class only, every score is that class; other columns pass through
``keep`` untouched.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fold, lent
from .wordhash import windows

MAX_ROWS = 3000
MAX_FEATURES = 50_000
BUCKETS = 1 << 20
LEAST_ROWS = 3
THRESHOLD = 0.3
FOLDS = 5

_X, _U, _D, _S = ord("x"), ord("X"), ord("9"), 32
_SHAPE = bytes(_S if c in b" \t\n\x0b\x0c\r" else _D if 48 <= c <= 57 else _U if 65 <= c <= 90 else _X if 97 <= c <= 122 or c >= 128 else c for c in range(256))
_FOLDS = np.zeros(256, bool)
_FOLDS[[_X, _U, _D, _S]] = True


def shapes(text: str | None) -> list[bytes]:
    """The shape of each word; a word that repeats its predecessor ends in a tab."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return []
    signs = np.frombuffer(raw.translate(_SHAPE), dtype=np.uint8)
    kept = np.ones(len(signs), bool)
    kept[1:] = (signs[1:] != signs[:-1]) | ~_FOLDS[signs[1:]]
    found = signs[kept].tobytes().split()
    again = [i + 1 for i, (a, b) in enumerate(zip(words, words[1:], strict=False)) if a == b]
    for i in again:
        found[i] += b"\t"
    return found


def ngrams(text: str | None) -> set:
    """Indicators: shapes, pairs and triples of neighbouring shapes."""
    s = shapes(text)
    return {*s, *zip(s, s[1:], strict=False), *zip(s, s[1:], s[2:], strict=False)}


def _plain(gram) -> bytes:
    return gram if isinstance(gram, bytes) else b" ".join(gram)


def places(text: str | None) -> np.ndarray:
    """Buckets of the words, pairs of words and character n-grams of a text; an n-gram may come twice."""
    low = (text or "").lower()
    w = np.fromiter((zlib.crc32(x) for x in low.encode("utf-8", "surrogatepass").split()), np.uint64)
    c = np.frombuffer(" ".join(low.split()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = [windows(x, np.arange(len(x) - n + 1), n, seed) for seed, x, n in ((1, w, 1), (1, w, 2), (2, c, 2), (2, c, 3)) if len(x) >= n]
    return (np.concatenate(found) >> np.uint64(44)).astype(np.int32) if found else np.zeros(0, np.int32)


class Model:
    """A weight for each n-gram and bucket, an intercept and a logistic curve of the margin."""

    def __init__(self, weights: dict, bias: float, slope: float, offset: float, buckets: np.ndarray | None = None, lexical: np.ndarray | None = None):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset
        self.buckets, self.lexical = (np.zeros(0, np.int32), np.zeros(0)) if buckets is None else (buckets, lexical)
        self.at = None

    def __getstate__(self):
        return {**self.__dict__, "at": None}

    def margin(self, text: str | None) -> float:
        get = self.weights.get
        found = [w for g in ngrams(text) if (w := get(g)) is not None]
        return self.bias + sum(found) / max(1.0, len(found)) ** 0.5 + self.words_margin(text)

    def words_margin(self, text: str | None) -> float:
        if not len(self.buckets):
            return 0.0
        if self.at is None:
            self.at = np.full(BUCKETS, -1, np.int32)
            self.at[self.buckets] = np.arange(len(self.buckets))
        i = self.at[places(text)]
        i = np.unique(i[i >= 0])
        return float(self.lexical[i].sum()) / max(1, len(i)) ** 0.5

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(text) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, n: int, alpha: float = 1.0) -> np.ndarray:
    p = np.full(n, alpha)
    q = np.full(n, alpha)
    for r, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[r] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, n: int, cost: np.ndarray, epochs: int = 30, seed: int = 5) -> np.ndarray:
    """Weights of an L2-regularised L2-loss hinge model; the last weight is the intercept's."""
    w, alpha = np.zeros(n + 1), np.zeros(len(rows))
    diag = 1 / (2 * cost)
    norms = np.array([v @ v + 1.0 for v in values]) + diag
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            r, v = rows[i], values[i]
            g = y[i] * (w[r] @ v + w[n]) - 1 + diag[i] * alpha[i]
            if alpha[i] == 0 and g >= 0:
                continue
            most = max(most, abs(g))
            new = max(alpha[i] - g / norms[i], 0.0)
            step = (new - alpha[i]) * y[i]
            alpha[i] = new
            w[r] += step * v
            w[n] += step
        if most < 1e-2:
            break
    return w


def logistic_curve(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton steps, with the usual smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        grad = x @ (p - t)
        hess = (x * (p * (1 - p))) @ x.T + np.eye(2) * 1e-6
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit_rows(grams: list[list[bytes]], labels: list[int], max_features: int = MAX_FEATURES, c: float = 1.0, hashed: list[np.ndarray] | None = None) -> Model:
    """Fits on n-gram lists (joined by a space), sorted bucket lists of the same rows, and labels 0/1."""
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    if len(set(labels)) < 2:
        return Model({}, 0.0, 0.0, 30.0 if labels and labels[0] else -30.0 if labels else 0.0)
    seen = Counter(g for row in grams for g in row)
    kept = sorted((g for g, k in seen.items() if k >= LEAST_ROWS), key=lambda g: (-seen[g], g))[:max_features]
    at = {g: i for i, g in enumerate(kept)}
    rows = [np.array(sorted(at[g] for g in row if g in at), dtype=np.int32) for row in grams]
    hashed = hashed if hashed is not None else [np.zeros(0, np.int32)] * len(grams)
    held = np.zeros(BUCKETS, np.int64)
    for h in hashed:
        held[h] += 1
    buckets = np.argsort(-held, kind="stable")[: min(max_features, int((held >= LEAST_ROWS).sum()))].astype(np.int32)
    place = np.full(BUCKETS, -1, np.int32)
    place[buckets] = np.arange(len(buckets), dtype=np.int32)
    more = [np.sort(i[i >= 0]) for i in (place[h] for h in hashed)]
    del hashed
    ratio = log_count_ratios(rows, y, len(kept))
    more_ratio = log_count_ratios(more, y, len(buckets))
    values = []
    for k, (r, i) in enumerate(zip(rows, more, strict=True)):  # unit blocks: long texts weigh no more than short ones while fitting
        values.append(np.concatenate([ratio[r] / max(1.0, np.sqrt(len(r))), more_ratio[i] / max(1.0, np.sqrt(len(i)))]).astype(np.float32))
        rows[k], more[k] = np.concatenate([r, i + np.int32(len(kept))]), None
    share = np.array([(y > 0).mean(), (y <= 0).mean()])
    cost = c * np.where(y > 0, 0.5 / share[0], 0.5 / share[1])
    w = dual_coordinate_descent(rows, values, y, len(kept) + len(buckets), cost)
    margin = np.array([w[r] @ v + w[-1] for r, v in zip(rows, values, strict=True)])
    slope, offset = logistic_curve(margin, y)
    found = {}
    for g, i in at.items():
        parts = tuple(g.split(b" "))
        found[parts if len(parts) > 1 else g] = float(w[i] * ratio[i])
    return Model(found, float(w[-1]), slope, offset, buckets, w[len(kept) : -1] * more_ratio)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> Model:
    """Fits on a bounded sample of labelled rows outside the held-out fold."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_y")).where(F.col("_y").isNotNull() & F.col("_id").isNotNull() & (fold(F.col("_id"), FOLDS) != 0))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    pick = lambda v: known.where(F.col("_y") == v).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    sample = pick(1).union(pick(0))

    # one packed value a row: the driver's memory holds each n-gram once
    @F.pandas_udf("g binary, h binary")
    def packed(texts: pd.Series) -> pd.DataFrame:
        g = [zlib.compress(b"\n".join(_plain(g) for g in ngrams(t)), 1) for t in texts]
        h = [zlib.compress(np.diff(np.unique(places(t)), prepend=np.int32(0)).tobytes(), 1) for t in texts]
        return pd.DataFrame({"g": g, "h": h})

    # at most 2 * max_rows ids are broadcast
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id")
    rows = rows.select("_id", "_y", packed("_text").alias("p")).select("_id", "_y", "p.*").collect()
    rows.sort(key=lambda r: (r["_id"], r["_y"]), reverse=True)
    once: dict[bytes, bytes] = {}
    grams, y, hashed = [], [], []
    while rows:
        r = rows.pop()
        grams.append([once.setdefault(g, g) for g in zlib.decompress(r["g"]).split(b"\n") if g])
        hashed.append(np.cumsum(np.frombuffer(zlib.decompress(r["h"]), np.int32), dtype=np.int32))
        y.append(int(r["_y"]))
    return fit_rows(grams, y, hashed=hashed)


def scorer(spark, model: Model):
    """A column function from text to score, the model broadcast (twice ``MAX_FEATURES`` weights at most)."""
    bounded(spark)
    shared = spark.sparkContext.broadcast(model)
    with lent():  # the sample and its matrix are gone
        pass

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype=float)

    return score


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", **options) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns."""
    model = fit(docs, labels, text=text, **options)
    return docs.where(scorer(docs.sparkSession, model)(F.col(text)) >= threshold)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of query op5."""
    score = scorer(docs.sparkSession, fit(docs, labels))
    rows = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
