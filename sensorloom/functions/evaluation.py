"""Evaluation: conformal p-values, martingales, ranking metrics, thresholds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The exponents of the mixture martingale.
EPSILONS = tuple(round(0.1 * i, 1) for i in range(1, 10))


#: Ranges that a running count over all rows is cut into.
RANGES = 200


def running_count(rows: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over rows whose ``by`` is at or above a row's own.

    Rows fall into ranges of ``by`` at its rough quantiles, ``RANGES`` of them at most; each range
    is summed in a window of its own, on top of the totals of the ranges above it.
    """
    marks = sorted(set(rows.stat.approxQuantile(by, [i / RANGES for i in range(1, RANGES)], 0.002)))
    place = F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: m <= F.col(by))) if marks else F.lit(0)
    rows = rows.withColumn("_range", place)
    totals = rows.groupBy("_range").agg(F.sum(value).alias("_t"))
    above = F.sum("_t").over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1))  # one row per range
    base = totals.select("_range", F.coalesce(above, F.lit(0)).alias("_base"))
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(F.desc(by)))
    return rows.join(F.broadcast(base), "_range").withColumn(out, inside + F.col("_base")).drop("_range", "_base")


def conformal_offline(calibration: DataFrame, stream: DataFrame, score: str = "score", order: str = "idx") -> DataFrame:
    """Adds p: (calibration scores at or above, plus one) over (their number plus one).

    Both tables meet in sorted windows over ranges of scores instead of a join of all pairs:
    counts at or above come from a running count over the union of the distinct scores.
    """
    both = calibration.groupBy(score).agg(F.count(F.lit(1)).alias("k")).withColumn("asked", F.lit(False))
    asks = stream.select(score).distinct().select(score, F.lit(0).cast("long").alias("k"), F.lit(True).alias("asked"))
    scores = both.unionByName(asks).groupBy(score).agg(F.sum("k").alias("k"), F.max("asked").alias("asked"))
    above = running_count(scores, score, "k", "above").where("asked")
    n = calibration.agg(F.count(F.lit(1)).alias("n"))
    return stream.join(above.select(score, "above"), score).crossJoin(F.broadcast(n)).withColumn("p", (F.col("above") + 1) / (F.col("n") + 1)).drop("above", "n")


def conformal_online(calibration: np.ndarray, stream: np.ndarray) -> np.ndarray:
    """As offline, but every scored value joins the pool: O(n log n) by bisection."""
    import bisect

    pool, out = sorted(map(float, calibration)), []
    for x in map(float, stream):
        out.append((len(pool) - bisect.bisect_left(pool, x) + 1) / (len(pool) + 1))
        bisect.insort(pool, x)
    return np.array(out)


def conformal_online_by(stream: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """Online p-values by group; rows with ``calibration`` true start the pool."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx", kind="stable")
        rest = frame[~frame["calibration"]].copy()
        rest["p"] = conformal_online(frame.loc[frame["calibration"], "score"].to_numpy(), rest["score"].to_numpy())
        return rest

    return stream.groupBy(*keys).applyInPandas(run, schema)


def power_martingale(rows: DataFrame, epsilon: float, keys: list[str], order: str = "idx", p: str = "p") -> DataFrame:
    """Adds log_m: the running sum of ln(eps) + (eps - 1) ln(p)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("log_m", F.sum(math.log(epsilon) + (epsilon - 1) * F.log(p)).over(w))


def mixture_martingale(rows: DataFrame, keys: list[str], order: str = "idx", p: str = "p") -> DataFrame:
    """Adds log_m: the log of the mean of the power martingales; all share one window."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_s", F.sum(F.log(p)).over(w))
    logs = F.array(*(F.col("_n") * math.log(e) + (e - 1) * F.col("_s") for e in EPSILONS))
    top = F.array_max(logs)
    mean = F.aggregate(F.transform(logs, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x) / len(EPSILONS)
    return rows.withColumn("log_m", top + F.log(mean)).drop("_n", "_s")


def martingale_alarm(rows: DataFrame, keys: list[str], delta: float, order: str = "idx") -> DataFrame:
    """keys, alarm: the first index at or above ln(1 / delta), else null."""
    return rows.groupBy(*keys).agg(F.min(F.when(F.col("log_m") >= math.log(1 / delta), F.col(order))).alias("alarm"))


def clock_control(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds clock: a row's place in its record, the score of a detector that only knows the time."""
    return rows.withColumn("clock", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def _by_score(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score, positives and negatives at it and above it; one row per distinct score."""
    each = rows.groupBy(*keys, "score").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.sum(1 - F.col("label").cast("long")).alias("neg"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return each.withColumns({"tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w), "all_pos": F.sum("pos").over(whole), "all_neg": F.sum("neg").over(whole)})


def precision_recall(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score, precision, recall per distinct score."""
    c = _by_score(rows, keys)
    return c.select(*keys, "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("all_pos")).alias("recall"))


def ranking_metrics(rows: DataFrame, keys: list[str], recall_floor: float = 0.8) -> DataFrame:
    """keys, auc (ties count half), ap (step), precision_at (best precision at recall >= floor); null for one class."""
    c = _by_score(rows, keys)
    pairs = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    step = F.sum(F.col("pos") / F.col("all_pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    both = (F.max("all_pos") > 0) & (F.max("all_neg") > 0)
    best = F.max(F.when(F.col("tp") >= recall_floor * F.col("all_pos"), F.col("tp") / (F.col("tp") + F.col("fp"))))
    c = c.where("all_pos > 0 and all_neg > 0")
    return c.groupBy(*keys).agg(F.when(both, pairs / (F.max("all_pos") * F.max("all_neg"))).alias("auc"), F.when(both, step).alias("ap"), F.when(both, best).alias("precision_at"))


def worst_baseline_threshold(baseline: DataFrame, score: str = "score") -> float | None:
    return baseline.agg(F.max(score)).first()[0]


def fires(score: Column, threshold: Column) -> Column:
    return score > threshold


def far_floor(k: int) -> float:
    """False-alarm rate that k baseline windows can't go below."""
    if k < 1:
        raise ValueError("at least one baseline window is needed")
    return 1 / (k + 1)


def over_floor(rate: float, k: int) -> float:
    return rate / far_floor(k)
