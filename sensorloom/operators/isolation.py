"""Isolation forests on feature rows: each tree's sample drawn from all rows, scored in batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TREES, SAMPLE = 100, 256


def _depth(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, left: int):
    spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
    if left == 0 or not len(spread):
        return len(x)
    j = int(rng.choice(spread))
    cut = rng.uniform(x[:, j].min(), x[:, j].max())
    side = x[:, j] < cut
    return (j, cut, _grow(x[side], rng, left - 1), _grow(x[~side], rng, left - 1))


def _paths(tree, x: np.ndarray, depth: float = 0.0) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), depth + _depth(tree))
    j, cut, a, b = tree
    out, side = np.empty(len(x)), x[:, j] < cut
    out[side], out[~side] = _paths(a, x[side], depth + 1), _paths(b, x[~side], depth + 1)
    return out


def train(rows: np.ndarray, seed: int = 42, trees: int = TREES, sample: int = SAMPLE) -> tuple[list, int]:
    rng = np.random.default_rng(seed)
    size = min(sample, len(rows))
    return [_grow(rows[rng.choice(len(rows), size, replace=False)], rng, int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees)], size


def score(model: tuple[list, int], rows: np.ndarray) -> np.ndarray:
    """Between 0 and 1; higher is more anomalous."""
    trees, size = model
    return 2 ** -(np.mean([_paths(t, rows) for t in trees], axis=0) / max(_depth(size), 1e-9))


def _uniform(h: np.ndarray, tree: int, draw: int, seed: int) -> np.ndarray:
    """Between 0 and 1, fixed by the row's hash, tree, draw and seed."""
    x = h + np.uint64((seed * 1_000_003 + tree * 65_537 + draw + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53


def samples(features: DataFrame, columns: list[str], seed: int = 42, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """tree, u and columns: the ``sample`` complete rows of least u by tree, drawn from all rows without replacement.

    Every row has a u of its own by tree: a row found n times has the order statistics of n draws, so
    equal rows count as often as they come, and neither skew nor partitions change the result.
    """
    rows = features.na.drop(subset=columns).groupBy(*(F.col(c).cast("double").alias(c) for c in columns)).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("_h", F.xxhash64(*columns))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [(np.zeros(0), np.zeros((0, len(columns))))] * trees
        for b in batches:
            x, n, h = b[columns].to_numpy(float), b["_n"].to_numpy(), b["_h"].to_numpy(np.int64).view(np.uint64)
            for t, (u, held) in enumerate(best):
                most = u[-1] if len(u) == sample else 1.0
                at, last = np.arange(len(x)), np.zeros(len(x))
                us, ats = [], []
                for k in range(sample):
                    last = 1 - (1 - last) * (1 - _uniform(h[at], t, k, seed)) ** (1 / (n[at] - k))
                    near = last <= most
                    us.append(last[near])
                    ats.append(at[near])
                    more = near & (n[at] > k + 1)
                    at, last = at[more], last[more]
                    if not len(at):
                        break
                u, held = np.concatenate([u, *us]), np.concatenate([held, x[np.concatenate(ats)]])
                first = np.argsort(u, kind="stable")[:sample]
                best[t] = u[first], held[first]
        for t, (u, held) in enumerate(best):
            if len(u):
                yield pd.DataFrame(held, columns=columns).assign(tree=t, u=u)[["tree", "u", *columns]]

    drawn = rows.mapInPandas(draw, ", ".join(["tree int", "u double", *(f"`{c}` double" for c in columns)]))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("u", *columns))
    return drawn.withColumn("_k", place).where(F.col("_k") <= sample).drop("_k")


def fit(features: DataFrame, columns: list[str], seed: int = 42) -> tuple[list, int]:
    """Fits on complete rows; only each tree's sample reaches the driver."""
    drawn = samples(features, columns, seed).toPandas().sort_values(["tree", "u", *columns])
    rng = np.random.default_rng(seed)
    parts = [p[columns].to_numpy(float) for _, p in drawn.groupby("tree")]
    size = len(parts[0]) if parts else 0
    return [_grow(x, rng, int(np.ceil(np.log2(max(size, 2))))) for x in parts], size


def score_rows(features: DataFrame, columns: list[str], model: tuple[list, int]) -> DataFrame:
    """Adds score; incomplete rows get null."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for b in batches:
            x, out = b.to_numpy(float), np.full(len(b), np.nan)
            good = np.isfinite(x).all(1)
            out[good] = score(shared.value, x[good])
            yield pd.Series(out).where(good, None).astype("Float64")

    return features.withColumn("score", run(F.struct(*columns)))
