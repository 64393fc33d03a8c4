"""Multivariate monitoring: aligned grids, PCA limits, T-squared and SPE."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AlignmentRefusal, ZeroSpreadBaseline
from .physics import TAG

#: Tags of one model: the p x p matrix is solved on the driver.
MAX_TAGS = 2000


def common_rate(tags: DataFrame) -> int:
    """The one declared whole-second rate of all tags."""
    rates = [r[0] for r in tags.select("sample_rate_s").distinct().limit(3).collect()]
    if len(rates) != 1 or rates[0] is None or rates[0] != int(rates[0]) or rates[0] < 1:
        raise AlignmentRefusal("tags must declare one common rate of whole seconds")
    return int(rates[0])


def grid(start: datetime, end: datetime, rate_s: int, spark) -> DataFrame:
    """Instants start, start + rate, ... up to end."""
    n = int((end - start).total_seconds() // rate_s)
    return spark.range(n + 1).select((F.timestamp_micros(F.unix_micros(F.lit(start)) + F.col("id") * (rate_s * 1_000_000))).alias("ts"))


def align(valid: DataFrame, points: list[str], start: datetime, end: datetime, rate_s: int, least: float = 0.95) -> tuple[DataFrame, float]:
    """Complete rows of the grid, a column per point in sorted order, and the share of filled cells.

    Stamps must match exactly; nothing is interpolated.
    """
    points = sorted(points)
    if end <= start:
        raise AlignmentRefusal("the windows do not overlap")
    rows = valid.where(F.col("point_id").isin(points) & F.col("ts").between(F.lit(start), F.lit(end)))
    if rows.select("source_id").distinct().limit(2).count() > 1:
        raise AlignmentRefusal("the tags are of several sources; name one")
    wide = rows.groupBy("ts").pivot("point_id", points).agg(F.first("value"))
    twice = rows.groupBy("point_id", "ts").count().where("count > 1").limit(1).count()
    if twice:
        raise AlignmentRefusal("a tag has several values at one stamp")
    full = grid(start, end, rate_s, valid.sparkSession).join(wide, "ts", "left")
    n, filled = full.agg(F.count(F.lit(1)), sum(F.count(F.col(f"`{p}`")) for p in points)).first()
    share = filled / (n * len(points)) if n else 0.0
    if share < least:
        raise AlignmentRefusal(f"{share:.1%} of the grid's cells are filled; {least:.0%} are needed")
    return full.na.drop(subset=[f"`{p}`" for p in points]), share


@dataclass(frozen=True)
class Pca:
    points: list[str]
    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray
    variances: np.ndarray
    explained: float
    t2_limit: float
    spe_limit: float | None


def _vector(points: list[str]) -> Column:
    return F.array(*(F.col(f"`{p}`") for p in points))


#: Up to so many tags the sums of products are plain aggregates; beyond, each task multiplies its own rows.
MOST_EXPRESSIONS = 24


def gram(rows: DataFrame, points: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """n, means and covariances (n - 1), in two passes: means, then sums of products about them."""
    p = len(points)
    if p > MAX_TAGS:
        raise AlignmentRefusal(f"{p} tags; a model takes {MAX_TAGS} at most")
    cols = [F.col(f"`{x}`") for x in points]
    if p <= MOST_EXPRESSIONS:
        stats = rows.agg(F.count(F.lit(1)), *(F.avg(c) for c in cols), *(F.covar_samp(cols[i], cols[j]) for i in range(p) for j in range(i + 1))).first()
        n, mean = stats[0], np.array(stats[1 : p + 1], float)
        cov = np.zeros((p, p))
        cov[np.tril_indices(p)] = np.array(stats[p + 1 :], float)
        return n, mean, cov + np.tril(cov, -1).T
    first = rows.agg(F.count(F.lit(1)), *(F.avg(c) for c in cols)).first()
    n, mean = first[0], np.array(first[1:], float)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(p), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    parts = rows.select(*(c.cast("double").alias(f"c{k}") for k, c in enumerate(cols))).mapInArrow(products, "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    cov = np.zeros((p, p))
    cov[sums["i"].to_numpy(), sums["j"].to_numpy()] = sums["v"].to_numpy()
    return n, mean, cov / (n - 1) if n > 1 else cov * np.nan


def fit(train: DataFrame, points: list[str], variance: float = 0.95, quantile: float = 0.99) -> Pca:
    """Standardised PCA; limits are quantiles of the training rows' own T-squared and SPE."""
    points = sorted(points)
    _, mean, cov = gram(train, points)
    scale = np.sqrt(np.diag(cov))
    if (scale == 0).any():
        raise ZeroSpreadBaseline(f"no spread: {', '.join(p for p, s in zip(points, scale, strict=True) if s == 0)}")
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    ratio = np.cumsum(values / values.sum())
    k = min(int(np.searchsorted(ratio, variance)) + 1, len(points))
    vectors = vectors[:k]
    sign = np.sign(vectors[np.arange(k), np.abs(vectors).argmax(1)])
    vectors = vectors * sign[:, None]
    model = Pca(points, mean, scale, vectors, values[:k], float(ratio[k - 1]), float("inf"), None)
    q = score(train, model).agg(F.percentile("t2", F.lit(quantile)), F.percentile("spe", F.lit(quantile))).first()
    return Pca(points, mean, scale, vectors, values[:k], float(ratio[k - 1]), float(q[0]), None if k == len(points) else float(q[1]))


def score(rows: DataFrame, model: Pca) -> DataFrame:
    """Adds t2, spe and resid (array by point): array functions, or a matrix product by batch for many tags."""
    if len(model.points) > MOST_EXPRESSIONS:
        return _score_many(rows, model)
    z = F.array(*((F.col(f"`{p}`") - float(m)) / float(s) for p, m, s in zip(model.points, model.mean, model.scale, strict=True)))
    out = rows.withColumn("_z", z)
    dot = lambda row: sum((F.get("_z", F.lit(j)) * float(x) for j, x in enumerate(row)), F.lit(0.0))
    out = out.withColumn("_t", F.array(*(dot(row) for row in model.loadings)))
    t2 = sum((F.pow(F.get("_t", F.lit(i)), 2) / max(float(v), 1e-12) for i, v in enumerate(model.variances)), F.lit(0.0))
    back = [sum((F.get("_t", F.lit(i)) * float(model.loadings[i, j]) for i in range(len(model.loadings))), F.lit(0.0)) for j in range(len(model.points))]
    out = out.withColumn("resid", F.array(*(F.get("_z", F.lit(j)) - b for j, b in enumerate(back))))
    spe = F.aggregate("resid", F.lit(0.0), lambda s, x: s + x * x)
    return out.withColumn("t2", t2).withColumn("spe", spe).drop("_z", "_t")


def _score_many(rows: DataFrame, model: Pca) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)  # MAX_TAGS squared numbers at most, 32 MB

    @F.pandas_udf("t2 double, spe double, resid array<double>")
    def run(values: pd.Series) -> pd.DataFrame:
        m = shared.value
        z = (np.stack(values.to_list()) - m.mean) / m.scale
        t = z @ m.loadings.T
        resid = z - t @ m.loadings
        return pd.DataFrame({"t2": (t**2 / np.maximum(m.variances, 1e-12)).sum(1), "spe": (resid**2).sum(1), "resid": list(resid)})

    whole = F.array(*(F.col(f"`{p}`").cast("double") for p in model.points))
    out = rows.withColumn("_m", run(whole))
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), F.col("_m.t2").alias("t2"), F.col("_m.spe").alias("spe"), F.col("_m.resid").alias("resid"))


def detect(rows: DataFrame, model: Pca, top: int = 3) -> DataFrame:
    """ts, t2, spe, t2_breach, spe_breach (strictly above the limits) and the points that contribute most."""
    weight = np.abs(model.loadings).sum(0)
    found = score(rows, model)
    part = F.array(*(F.struct((F.abs(F.get("resid", F.lit(j))) * float(w)).alias("weight"), F.lit(p).alias("point_id")) for j, (p, w) in enumerate(zip(model.points, weight, strict=True))))
    over = F.lit(False) if model.spe_limit is None else F.col("spe") > model.spe_limit
    return found.select("ts", "t2", "spe", (F.col("t2") > model.t2_limit).alias("t2_breach"), over.alias("spe_breach"), F.transform(F.slice(F.sort_array(part, asc=False), 1, top), lambda x: x["point_id"]).alias("contributors"))


def monitor(valid: DataFrame, tags: DataFrame, baseline: tuple[datetime, datetime], window: tuple[datetime, datetime], rate_s: int | None = None, variance: float = 0.95, quantile: float = 0.99, least: float = 0.95) -> tuple[Pca, DataFrame]:
    """The model of a baseline window and what it finds in a disjoint window.

    tags: tag, sample_rate_s of the tags to use, all of one source. A stamp on a common border belongs to the window.
    """
    if baseline[0] < window[1] and window[0] < baseline[1]:
        raise AlignmentRefusal("the baseline and the window overlap")
    points = sorted(r["point_id"] for r in tags.select("point_id").limit(MAX_TAGS + 1).collect())
    if not 2 <= len(points) <= MAX_TAGS:
        raise AlignmentRefusal(f"{len(points)} tags; a model takes 2 to {MAX_TAGS}")
    rate = rate_s or common_rate(tags)
    train = valid.where(F.col("ts") != F.lit(window[0])) if baseline[1] == window[0] else valid
    model = fit(align(train, points, *baseline, rate, least)[0], points, variance, quantile)
    return model, detect(align(valid, points, *window, rate, least)[0], model)
