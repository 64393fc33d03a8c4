"""Flatline verdicts: is a tag frozen, as judged by its own past?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import change_intervals, reference_windows, stall
from .physics import TAG

FLAT_STD = 1e-9


def assess(window: DataFrame, history: DataFrame, span_s: float, start, censored: DataFrame | None = None, coupled: DataFrame | None = None) -> DataFrame:
    """tag, stall_s, stall_p99, n_distinct, distinct_p05, verdict, reason.

    window, history: annotated rows. censored: tag, censored. coupled: tag, other (a point that
    should move with it). Gates in order: saturated, mode tag, no valid rows, no evaluable signal.
    """
    valid, past = window.where("valid"), history.where("valid")
    tags = window.groupBy(*TAG).agg(F.max(F.col("state").isNotNull() if "state" in window.columns else F.lit(False)).alias("is_mode"), F.count_if("valid").alias("n_valid"))
    now = valid.groupBy(*TAG).agg(F.count_distinct("value").alias("n_distinct"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.avg("value").alias("mean"))
    windows = reference_windows(past, span_s, start)
    first = past.groupBy(*TAG).agg(F.min("ts").alias("t0"))
    bucketed = past.join(first, TAG).withColumn("bucket", F.floor((F.unix_micros("ts") - F.unix_micros("t0")) / 1e6 / span_s))
    kept = bucketed.join(windows.select(*TAG, "bucket"), [*TAG, "bucket"], "left_semi")
    steps = change_intervals(kept, "bucket").groupBy(*TAG).agg(F.percentile("interval_s", F.lit(0.99)).alias("stall_p99"))
    counts = windows.groupBy(*TAG).agg(F.percentile("distinct", F.lit(0.05)).alias("distinct_p05"))
    out = tags.join(now, TAG, "left").join(stall(valid).select(*TAG, "stall_s"), TAG, "left").join(steps, TAG, "left").join(counts, TAG, "left")
    out = out.join(censored.select(*TAG, "censored"), TAG, "left") if censored is not None else out.withColumn("censored", F.lit(None).cast("boolean"))
    flat = F.col("std") <= FLAT_STD * F.greatest(F.lit(1.0), F.abs("mean"))
    if coupled is not None:
        moves = now.select("source_id", F.col("point_id").alias("other"), (~flat).alias("moves"))
        partner = coupled.join(moves, ["source_id", "other"], "left").groupBy(*TAG).agg(F.max("moves").alias("partner_moves"))
        out = out.join(partner, TAG, "left")
    else:
        out = out.withColumn("partner_moves", F.lit(None).cast("boolean"))
    one = F.col("stall_s") > F.col("stall_p99")
    two = F.col("n_distinct") < F.col("distinct_p05")
    three = F.when(F.col("partner_moves").isNotNull(), flat & F.col("partner_moves"))
    fired = F.coalesce(one, F.lit(False)) | F.coalesce(two, F.lit(False)) | F.coalesce(three, F.lit(False))
    reason = F.when(F.col("censored"), "saturated").when(F.col("is_mode"), "mode tag").when(F.col("n_valid") == 0, "no valid rows").when(F.coalesce(one, two, three).isNull(), "no evaluable signal")
    verdict = F.when(reason.isNotNull(), "NOT ASSESSED").when(fired, "FLATLINE").otherwise("OK")
    return out.select(*TAG, "stall_s", "stall_p99", "n_distinct", "distinct_p05", verdict.alias("verdict"), reason.alias("reason"))
