"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer turns words into signs: insult, threat, target, negation, reporting verb,
other, clause end. Three small transducers follow: one marks insults and threats in the scope of
a negation, one those behind a reporting verb of their clause, one those whose clause has named a
target. They are composed into one machine, which reads a clause's signs and writes the path of
each match; what it left without a target is read again from the clause's end, for targets that
come after it. A clause's weight on a path is the weight of its strongest match; a document's
measure of a path is the log of one plus the sum over its clauses. The measures enter a logistic
curve, whose weights start from the grammar's own and are fitted to the labels. Threats before
their target, without one, negated or reported have paths of their own (``THREAT_PATHS``).

Target, negation, threat and reporting words are fixed lists; insults are learned: words and word
stems that toxic documents hold far more often than others, or significantly more often where they
are neither negated nor reported, weighted by their log-ratio.

Fitting takes at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled rows (by the smallest hash of their
id) outside the held-out fold; scoring covers every row and whole texts.

Defined cases: a null or empty text has no clause and gets the intercept's score; labels that
are null or of absent documents aren't used, of repeated ones the larger counts; without labels
of both classes the grammar's own weights hold; other columns are never looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fold, stage
from .neardup import shingles

MAX_TOXIC, MAX_CLEAN = 3000, 9000
FOLDS = 5
THRESHOLD = 0.5
STEMS = (4, 5, 6)
#: A learned insult is so many times as often in toxic documents as in others, and explains this
#: share of the toxic documents (LEAST_NEW at least) that those learned before it don't.
LEAST_RATIO, LEAST_SHARE, LEAST_NEW = 20.0, 0.001, 3
#: One whose open uses, neither negated nor reported, are so many times as often in toxic documents is
#: learned too if twice the log-likelihood ratio of its counts is so much.
OPEN_RATIO, OPEN_LEAST = 3.0, 20.0
#: Others are learned too if they are so many times as often in toxic documents, and in this share of
#: the toxic documents (SURE_NEW at least) of different kinds; near copies are of one kind.
SURE_RATIO, SURE_SHARE, SURE_NEW = 100.0, 0.02, 8

# Function words of English, German, French and Spanish.
TARGETS = "you your yours yourself he him she her they them their du dich dir dein deine ihr euch er sie tu te toi ton ta vous votre il elle ils elles tú ti tu usted ustedes él ella ellos ellas".split()
NEGATIONS = "not never no none nobody isn't aren't wasn't don't doesn't won't nicht nie kein keine keiner ne pas jamais nunca jamás".split()
REPORTING = "said says say told tells called calls wrote writes quoted quote claimed sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()
#: Verbs of threats by their stems, with the endings of each group of them.
THREAT_STEMS = {
    "kill hurt destroy beat burn shoot stab crush punish": " s es ed ing ned bed bing en",
    "töt verletz": "e en est et st t te ten test tet ete eten end",
    "schlag schläg": "e en st t end",
    "tu frapp bless": "er e es ons ez ent é ée és ées ait aient erai era erez eront ant",
    "mat golpe": "ar o as a amos an é ó aron aba ado ada aré ará arán ando",
}
THREAT_FORMS = "shot beaten schlug schlugen geschlagen getötet".split()
THREATS = sorted({v + e for verbs, ends in THREAT_STEMS.items() for v in verbs.split() for e in (ends.split() + [""] * ends.startswith(" "))} - {"tu", "tue"} | {"tue", *THREAT_FORMS})

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:,\n]")
SCOPE = 2
PATHS = ["plain", "targeted", "negated", "reported", "threat"]
#: Of threats whose target comes after them, or that have none, or are negated or reported.
THREAT_PATHS = ["aimed", "untargeted", "negated threat", "reported threat"]
#: The grammar's own weights, in the order of PATHS and THREAT_PATHS, and its intercept.
PRIOR = np.array([1.2, 1.5, 0.3, 0.3, 1.0, 1.0, 0.2, 0.1, 0.2])
PRIOR_BIAS = -2.5


class Transducer:
    """Deterministic: (state, sign) to (state, sign written); signs without an arc pass unchanged."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def step(self, state, sign):
        return self.arcs.get((state, sign), (state, sign))


def compose(first: Transducer, second: Transducer, alphabet: list[str]) -> Transducer:
    """The machine that feeds what ``first`` writes to ``second``, over its reachable states."""
    start = (first.start, second.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for sign in alphabet:
            a, between = first.step(state[0], sign)
            b, out = second.step(state[1], between)
            arcs[state, sign] = ((a, b), out)
            if (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    return Transducer(start, arcs)


#: Signs of a word: insult, threat, target, negation, reporting, other; and the clause end.
SIGNS = ["I", "H", "T", "N", "R", "o", "."]


def negation_machine(scope: int = SCOPE) -> Transducer:
    arcs = {}
    for left, sign in product(range(scope + 1), SIGNS):
        if sign == "N":
            arcs[left, sign] = (scope, sign)
        elif sign == ".":
            arcs[left, sign] = (0, sign)
        else:
            arcs[left, sign] = (max(0, left - 1), f"n{sign}" if left and sign in "IH" else sign)
    return Transducer(0, arcs)


def reporting_machine() -> Transducer:
    arcs = {}
    for told in (False, True):
        arcs[told, "R"] = (True, "R")
        arcs[told, "."] = (False, ".")
        for sign in ("I", "H"):
            arcs[told, sign] = (told, f"r{sign}" if told else sign)
    return Transducer(False, arcs)


def target_machine() -> Transducer:
    arcs = {}
    for named in (False, True):
        arcs[named, "T"] = (True, "T")
        arcs[named, "."] = (False, ".")
        for sign in ("I", "H"):
            arcs[named, sign] = (named, f"t{sign}" if named else sign)
    return Transducer(False, arcs)


def grammar() -> Transducer:
    return compose(compose(negation_machine(), reporting_machine(), SIGNS), target_machine(), SIGNS)


#: Path of what the grammar writes; Ht is a threat before its target.
PATH_OF = {"I": 0, "tI": 1, "nI": 2, "rI": 3, "tH": 4, "Ht": 5, "H": 6, "nH": 7, "rH": 8}
#: What has its target behind it, once the clause is read from its end.
AIMED = {"I": "tI", "H": "Ht"}


def strongest(written: list[tuple[str, float]]) -> dict[int, float]:
    """By path, the weight of a clause's strongest match; read from the clause's end."""
    best, named = {}, False
    for out, weight in reversed(written):
        if out == "T":
            named = True
            continue
        path = PATH_OF[AIMED.get(out, out) if named else out]
        best[path] = max(best.get(path, 0.0), weight)
    return best


class Lexicon(dict):
    """Sign and weight of a word, remembered; words of no sign give None."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__()
        self.words, self.stems = words, stems
        self.fixed = {w: (s, 1.0) for s, group in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTING), ("H", THREATS)) for w in group}

    def __missing__(self, word: str):
        if len(self) > 500_000:
            self.clear()
        weight = max([self.words.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in STEMS if len(word) > k)])
        self[word] = found = self.fixed.get(word) or (("I", weight) if weight else None)
        return found


class Model:
    def __init__(self, words: dict[str, float], stems: dict[str, float], weights: np.ndarray, bias: float):
        self.words, self.stems, self.weights, self.bias = words, stems, weights, bias
        self.lexicon = self.machine = None

    def __getstate__(self):
        return {**self.__dict__, "lexicon": None, "machine": None}

    def measures(self, text: str | None) -> np.ndarray:
        """Those of PATHS alone."""
        return self.all_measures(text)[: len(PATHS)]

    def all_measures(self, text: str | None) -> np.ndarray:
        """By path, the log of one plus the sum of the clauses' weights."""
        if self.lexicon is None:
            self.lexicon, self.machine = Lexicon(self.words, self.stems), grammar()
        total = np.zeros(len(PRIOR))
        signs = self.lexicon
        tokens = _TOKEN.findall((text or "").lower())
        found = [s[0] for w in tokens if (s := signs[w]) is not None]
        if "I" not in found and "H" not in found:
            return total
        state, written = self.machine.start, []
        for word in [*tokens, "."]:
            if word in ".!?;:,\n":
                sign, weight = ".", 0.0
            else:
                sign, weight = signs[word] or ("o", 0.0)
            state, out = self.machine.step(state, sign)
            if sign == ".":
                for path, w in strongest(written).items():
                    total[path] += w
                written = []
            elif out == "T" or out in PATH_OF:
                written.append((out, weight))
        return np.log1p(total)

    def score(self, text: str | None) -> float:
        z = self.all_measures(text) @ self.weights + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def word_features(text: str | None) -> set[str]:
    """Words, and stems marked by a star, of a text."""
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    return words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}


OPENER = grammar()
FIXED = frozenset([*TARGETS, *NEGATIONS, *REPORTING, *THREATS])
_SIGN = {w: s for s, group in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTING)) for w in group} | dict.fromkeys(".!?;:,\n", ".")


def open_features(text: str | None) -> set[str]:
    """The features of words that are neither negated nor reported; fixed words have none."""
    words, state = set(), OPENER.start
    for word in _TOKEN.findall((text or "").lower()):
        state, out = OPENER.step(state, _SIGN.get(word, "I"))
        if out in ("I", "tI") and word not in FIXED:
            words.add(word)
    words = set().union(*(re.split("['’]", w) for w in words)) - FIXED
    return words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}


#: Least hashes of a text's shingles, each under an order of its own; near copies share some.
ORDERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def marks_of(text: str | None) -> list[int]:
    """The least hashes of a text's 3-word shingles."""
    found = shingles(text, 3)
    return [int((found * k).min() >> np.uint64(1)) for k in ORDERS] if len(found) else []


def kinds_of(marks: list[list[int]]) -> list[int]:
    """A number by text, the same for texts that share a mark, directly or through others."""
    up = list(range(len(marks)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    first: dict[tuple[int, int], int] = {}
    for i, some in enumerate(marks):
        for key in enumerate(some):
            a, b = top(first.setdefault(key, i)), top(i)
            up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(marks))]


def log_ratio(a: int, b: int, toxic: int, clean: int) -> float:
    return float(np.log((a + 0.5) / (toxic + 1) * (clean + 1) / (b + 0.5)))


def likelihood(a: int, b: int, toxic: int, clean: int) -> float:
    """Twice the log-likelihood ratio of two counts against one rate for both classes."""
    share = (a + b) / (toxic + clean)
    return 2 * sum(n * float(np.log(n / (size * share))) for n, size in ((a, toxic), (b, clean)) if n)


def insults(counts: list[tuple[str, int, int, int, int]], held: list[tuple[set[str], set[str], int]], toxic: int, clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Learned words and stems with their weights.

    counts: (feature, toxic documents, clean documents, those of each with an open use); held: features,
    openly used features and kind of each toxic document.
    The feature that explains most unexplained documents, less the clean documents that hold it,
    comes first, so that what merely stands in copies of one toxic document is never learned. One that
    is learned for its open uses alone must also be ``OPEN_RATIO`` times as often in unexplained ones.
    Whatever is learned stands in ``LEAST_NEW`` kinds of toxic documents; copies are of one kind.
    """
    ratio, against, openly = {}, {}, set()
    kinds: dict[str, set[int]] = {}
    for n, a, b, ao, bo in counts:
        r, o = log_ratio(a, b, toxic, clean), log_ratio(ao, bo, toxic, clean)
        if r >= np.log(LEAST_RATIO):
            ratio[n], against[n] = r, b
            if r >= np.log(SURE_RATIO):
                kinds[n] = set()
        elif ao >= LEAST_NEW and o >= np.log(OPEN_RATIO) and likelihood(ao, bo, toxic, clean) >= OPEN_LEAST:
            ratio[n], against[n] = o, bo
            openly.add(n)
    docs: dict[str, set[int]] = {n: set() for n in ratio}
    for i, (names, opened, kind) in enumerate(held):
        for n in names:
            if n in docs and n not in openly:
                docs[n].add(i)
            if n in kinds:
                kinds[n].add(kind)
        for n in opened & openly:
            docs[n].add(i)
    # the largest first; a stale place in the queue is put back with what is left of its documents
    rank = lambda n: (against[n] - len(docs[n]), n.endswith("*"), -len(n), [-ord(c) for c in n] + [1])
    queue = [(rank(n), n) for n in docs if len(docs[n]) >= LEAST_NEW]
    heapify(queue)
    kept: dict[str, float] = {}
    explained: set[int] = set()
    while queue:
        was, best = heappop(queue)
        docs[best] -= explained
        if len({held[i][2] for i in docs[best]}) < LEAST_NEW or len(docs[best]) < max(LEAST_NEW, LEAST_SHARE * toxic) or (best in openly and log_ratio(len(docs[best]), against[best], toxic, clean) < np.log(OPEN_RATIO)):
            continue
        if (now := rank(best)) != was:
            heappush(queue, (now, best))
            continue
        kept[best] = ratio[best] / 4
        explained |= docs[best]
    for n, found in kinds.items():
        if len(found) >= max(SURE_NEW, SURE_SHARE * toxic):
            kept[n] = ratio[n] / 4
    weigh = lambda stem: {n.rstrip("*"): w for n, w in kept.items() if n.endswith("*") == stem}
    return weigh(False), weigh(True)


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the intercept, pulled to ``prior``; both classes weigh the same.

    Newton steps, each halved until the loss gets no larger: where the curve is flat a whole step leads far away.
    """
    z, w = np.column_stack([x, np.ones(len(x))]), prior.copy()
    share = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    loss = lambda w: share @ np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ w)) + ridge / 2 * ((w - prior) @ (w - prior))
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        grad = z.T @ (share * (p - y)) + ridge * (w - prior)
        hess = (z * (share * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        while (then := loss(w - step)) > now + 1e-9 * abs(now) and abs(step).max() >= 1e-8:
            step = step / 2
        w, now = w - step, then
        if abs(step).max() < 1e-8:
            break
    return w


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic weights, pulled to the grammar's own.

    First one factor for all of the grammar's weights is fitted, then each path's weight about that:
    a path that the labelled rows say nothing about weighs as much as the grammar says it does
    beside the others.
    """
    if len(set(y.tolist())) < 2:
        return PRIOR, PRIOR_BIAS
    factor, bias = _logistic((x @ PRIOR)[:, None], y, np.array([1.0, PRIOR_BIAS]), ridge / 10)
    w = _logistic(x, y, np.append(max(factor, 1.0) * PRIOR, bias), ridge)
    w[1] = max(w[1], w[0])  # a target never excuses an insult
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> Model:
    bounded(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_y")).where(F.col("_y").isNotNull() & F.col("_id").isNotNull() & (fold(F.col("_id"), FOLDS) != 0))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    pick = lambda v, n: known.where(F.col("_y") == v).orderBy(F.xxhash64("_id"), "_id").limit(n)
    # at most MAX_TOXIC + MAX_CLEAN ids are broadcast
    sample = F.broadcast(pick(1, MAX_TOXIC).union(pick(0, MAX_CLEAN)))
    rows = stage(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(sample, "_id"), "sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {k: Counter() for k in range(4)}  # clean, toxic, and those with an open use
        for b in batches:
            for y, t in zip(b["_y"], b["_text"], strict=True):
                seen[int(y)].update(word_features(t))
                seen[int(y) + 2].update(open_features(t))
        names = [*(seen[0].keys() | seen[1].keys())]
        if names:
            yield pd.DataFrame({"name": names} | {c: [seen[k][n] for n in names] for c, k in (("a", 1), ("b", 0), ("ao", 3), ("bo", 2))})

    sizes = {int(r["_y"]): r["count"] for r in rows.groupBy("_y").count().collect()}
    counts = rows.select("_y", "_text").mapInPandas(count, "name string, a long, b long, ao long, bo long").groupBy("name").agg(*(F.sum(c).alias(c) for c in ("a", "b", "ao", "bo")))
    ratio = lambda a, b: ((F.col(a) + 0.5) / (sizes.get(1, 0) + 1)) / ((F.col(b) + 0.5) / (sizes.get(0, 0) + 1))
    share = F.greatest(F.col("ao") + F.col("bo"), F.lit(1)) / max(1, sizes.get(1, 0) + sizes.get(0, 0))
    likely = lambda c, y: 2 * F.col(c) * F.log(F.greatest(F.col(c), F.lit(1)) / (share * max(1, sizes.get(y, 0))))
    opened = (F.col("ao") >= LEAST_NEW) & (ratio("ao", "bo") >= OPEN_RATIO) & (likely("ao", 1) + likely("bo", 0) >= OPEN_LEAST)
    counts = counts.where((F.col("a") >= LEAST_NEW) & ((ratio("a", "b") >= LEAST_RATIO) | opened)).orderBy("name").collect()  # the sample bounds them
    names = rows.sparkSession.sparkContext.broadcast({r["name"] for r in counts})

    @F.pandas_udf("h array<string>, o array<string>, marks array<long>")
    def held(texts: pd.Series) -> pd.DataFrame:
        features = lambda f: [sorted(f(t) & names.value) for t in texts]
        return pd.DataFrame({"h": features(word_features), "o": features(open_features), "marks": [marks_of(t) for t in texts]})

    toxic = rows.where("_y = 1").select(held("_text").alias("x")).select("x.*").collect()
    kinds = kinds_of([r["marks"] for r in toxic])
    words, stems = insults([tuple(r) for r in counts], [(set(r["h"]), set(r["o"]), k) for r, k in zip(toxic, kinds, strict=True)], sizes.get(1, 0), sizes.get(0, 0))
    model = Model(words, stems, PRIOR, PRIOR_BIAS)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.all_measures(t) for t in texts], dtype=object)

    got = rows.select("_id", "_y", measure("_text").alias("x")).orderBy("_id", "_y").collect()
    if got:
        model.weights, model.bias = fit_weights(np.array([r["x"] for r in got]), np.array([int(r["_y"]) for r in got]))
    return model


def scorer(spark, model: Model):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype=float)

    return score


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of query op7."""
    score = scorer(docs.sparkSession, fit(docs, labels))
    rows = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
