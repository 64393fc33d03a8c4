"""Deterministic splits: stratified by hash rank, and whole groups held out."""

from __future__ import annotations

import hashlib
import statistics

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import GroupLeakage

SHARES = (("train", 0.70), ("val", 0.15), ("test", 0.15))


def largest_remainder(n: int, shares: tuple[float, ...]) -> list[int]:
    whole = [int(n * s) for s in shares]
    order = sorted(range(len(shares)), key=lambda i: (-(n * shares[i] - whole[i]), i))
    for i in order[: n - sum(whole)]:
        whole[i] += 1
    return whole


def stratified_split(rows: DataFrame, stratum: str, index: str, seed: int = 42) -> DataFrame:
    """Adds fold: rows of a stratum in the order of SHA-256(seed:stratum|index), cut 70 / 15 / 15."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(stratum), F.lit("|"), F.col(index).cast("string")).cast("binary"), 256)
    w = Window.partitionBy(stratum)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_k", F.row_number().over(w.orderBy(rank, index)))
    parts = F.array(*(F.floor(F.col("_n") * s + 1e-9).cast("long") for _, s in SHARES))
    rest = F.col("_n") - F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)
    left = F.array(*(F.struct((-(F.col("_n") * s - F.floor(F.col("_n") * s + 1e-9))).alias("r"), F.lit(i).alias("i")) for i, (_, s) in enumerate(SHARES)))
    order = F.sort_array(left)
    extra = lambda i: F.exists(F.slice(order, 1, 3), lambda x: (x["i"] == i) & (F.array_position(F.transform(order, lambda y: y["i"]), F.lit(i)) <= rest)).cast("long")
    train = F.get(parts, F.lit(0)) + extra(0)
    val = train + F.get(parts, F.lit(1)) + extra(1)
    fold = F.when(F.col("_k") <= train, "train").when(F.col("_k") <= val, "val").otherwise("test")
    return rows.withColumn("fold", fold).drop("_n", "_k")


def group_holdout(counts: list[tuple[str, str, int]], folds: int, seed: int = 42, column: str = "group") -> dict[str, int]:
    """Fold of each group, from (group, stratum, rows): large groups first, each to the fold that stays most even."""
    groups: dict[str, dict[str, int]] = {}
    for group, stratum, n in counts:
        groups.setdefault(group, {})[stratum] = groups.get(group, {}).get(stratum, 0) + n
    strata = sorted({s for g in groups.values() for s in g})
    key = lambda g: (-sum(groups[g].values()), hashlib.sha256(f"{seed}:{column}:{g}|0".encode()).hexdigest())
    held = [dict.fromkeys(strata, 0) for _ in range(folds)]
    out = {}
    for g in sorted(groups, key=key):
        best = None
        for f in range(folds):
            trial = [h | {s: h[s] + groups[g].get(s, 0) for s in strata} if i == f else h for i, h in enumerate(held)]
            cost = sum(statistics.pstdev([t[s] for t in trial]) for s in strata)
            rank = (cost, sum(trial[f].values()), f)
            if best is None or rank < best[0]:
                best = (rank, f, trial)
        out[g], held = best[1], best[2]
    return out


def group_folds(rows: DataFrame, group: str, stratum: str, folds: int, seed: int = 42) -> DataFrame:
    """Adds fold: groups are counted on the cluster, placed on the driver, and joined back."""
    counts = [(r[0], r[1], r[2]) for r in rows.groupBy(group, stratum).count().collect()]
    placed = group_holdout(counts, folds, seed, group)
    table = rows.sparkSession.createDataFrame(sorted(placed.items()), f"`{group}` string, fold int")
    return rows.join(F.broadcast(table) if len(placed) <= 100_000 else table, group)


def leakage_check(rows: DataFrame, group: str, fold: str = "fold") -> None:
    bad = rows.groupBy(group).agg(F.count_distinct(fold).alias("k")).where("k > 1").limit(3).collect()
    if bad:
        raise GroupLeakage(f"in more than one fold: {', '.join(str(r[0]) for r in bad)}")
