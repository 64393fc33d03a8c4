"""Plans: which steps run over which window; each step is one job over all tags."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refusal
from ..functions.quality import annotate
from ..functions.timebase import parse_window
from ..operators import baselines, features, physics, segments
from . import documents

STEPS = ("profile", "segment", "screen", "spc")
NEEDS_BASELINE = ("screen", "spc")


@dataclass(frozen=True)
class Plan:
    window: tuple[datetime, datetime]
    steps: tuple[str, ...]
    baseline: tuple[datetime, datetime] | None = None
    options: dict = field(default_factory=dict)


def load_plan(text: str) -> Plan:
    """A TOML plan; all of its errors show before any work."""
    doc = tomllib.loads(text)
    unknown = set(doc) - {"window", "baseline", "steps", "options"}
    if unknown:
        raise ValueError(f"unknown plan keys: {', '.join(sorted(unknown))}")
    steps = tuple(doc.get("steps", ()))
    bad = [s for s in steps if s not in STEPS]
    if bad or not steps:
        raise ValueError(f"steps must be some of {', '.join(STEPS)}" + (f", not {', '.join(bad)}" if bad else ""))
    window = parse_window(doc["window"])
    base = parse_window(doc["baseline"]) if "baseline" in doc else None
    if base is None and any(s in NEEDS_BASELINE for s in steps):
        raise ValueError("screen and spc need a baseline window")
    if base and base[0] < window[1] and window[0] < base[1]:
        raise ValueError("the baseline overlaps the window")
    return Plan(window, tuple(s for s in STEPS if s in steps), base, doc.get("options", {}))


def profile(rows: DataFrame) -> DataFrame:
    """tag with severities, features and order statistics."""
    return physics.severity_counts(rows).join(features.features(rows).drop("n"), physics.TAG, "left").join(features.order_statistics(rows), physics.TAG, "left")


def execute(samples: DataFrame, plan: Plan) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """Result tables by step, and refusal rows. Steps run in a fixed order."""
    rows = annotate(samples)
    window = physics.window(rows, *plan.window)
    results: dict[str, DataFrame] = {}
    refused = [physics.monotonic_refusals(window)]
    usable = None
    if plan.baseline:
        base = physics.window(rows, *plan.baseline).where("valid").where(F.col("ts") != F.lit(plan.window[0]))
        usable, none = baselines.split(baselines.mad_baseline(base), baselines.LEAST_ROWS, "baseline")
        refused += [none, baselines.missing_refusals(window.where("valid"), baselines.mad_baseline(base), step="baseline")]
    valid = window.where("valid")
    for step in plan.steps:
        if step == "profile":
            results[step] = profile(window)
        elif step == "segment":
            refused.append(segments.refusals(valid, plan.options.get("min_size", 10)))
            results[step] = segments.segment_table(valid, plan.options.get("penalty"), plan.options.get("min_size", 10))
        elif step == "screen":
            results[step] = baselines.screen(valid, usable, plan.options.get("k", 3.0)).where("flagged")
        else:
            c = baselines.chart(valid, usable)
            hits = [f(c).withColumn("rule", F.lit(n)) for n, f in (("BEYOND_3SIGMA", baselines.beyond_limits), ("RUN_9_SAMESIDE", baselines.run_of_nine), ("TREND_6", baselines.trend_of_six))]
            results[step] = hits[0].unionByName(hits[1]).unionByName(hits[2])
    out = refused[0]
    for r in refused[1:]:
        out = out.unionByName(r)
    return results, out


def ledger(title: str, results: dict[str, DataFrame], refusals: DataFrame, out: str | None = None) -> dict:
    """A document of the run: at most a thousand rows per step, how many more there are, and where all are.

    With ``out``, every result is written there whole, as Parquet, and the document is read from it.
    """
    body = {"title": title, "findings": {}, "dropped": {}, "tables": {}}
    for name, df in results.items():
        if out:
            body["tables"][name] = f"{out.rstrip('/')}/{name}"
            df.write.parquet(body["tables"][name])
            df = df.sparkSession.read.parquet(body["tables"][name])
        body["findings"][name], body["dropped"][name] = documents.rows_of(df)
    body["refusals"] = documents.rows_of(refusals)[0]
    return body


def run(samples: DataFrame, plan_text: str, title: str = "run", out: str | None = None) -> str:
    """The ledger as JSON, or a refusal document."""
    try:
        return documents.document("run", ledger(title, *execute(samples, load_plan(plan_text)), out))
    except Refusal as refusal:
        return documents.refusal_document(refusal)
