"""Streaming screens: fixed baselines against a stream of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quality import annotate
from ..operators.baselines import screen
from ..operators.physics import TAG


def screen_stream(samples: DataFrame, baselines: DataFrame, k: float = 3.0) -> DataFrame:
    """Flagged valid rows; a stateless stream-static join, so late rows never change a verdict."""
    return screen(annotate(samples).where("valid"), baselines, k).where("flagged").select(*TAG, "ts", "value", "low", "high")


def windowed_severity(samples: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Severity counts per tag and window; rows later than the watermark are left out for good."""
    rows = annotate(samples.withWatermark("ts", late))
    n = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}")
    return rows.groupBy(*TAG, F.window("ts", width).alias("w")).agg(n("GOOD"), n("UNCERTAIN"), n("BAD")).select(*TAG, F.col("w.start").alias("start"), "n_good", "n_uncertain", "n_bad")
