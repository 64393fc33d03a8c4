"""Seeded demo archives: a flow and a temperature with planted faults, a three-day trial, and a loop backbone."""

from __future__ import annotations

import math
from datetime import UTC, datetime, timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..contract import TagMeta
from ..operators import switchback

SCHEMA = "source_id string, point_id string, row_ix long, ts timestamp, value double, quality string"
T0 = datetime(2024, 3, 30, 20, tzinfo=UTC)
TRIAL0 = datetime(2024, 6, 1, tzinfo=UTC)
FLOW = TagMeta("demo", "FIC101.PV", "Feed flow", unit_raw="m3/h", eng_zero=0.0, eng_span=100.0, sample_rate_s=60.0, role="PV", loop_id="FIC101")
TEMPERATURE = TagMeta("demo", "TIC101.PV", "Outlet temperature", unit_raw="degC", eng_zero=0.0, eng_span=200.0, sample_rate_s=60.0, role="PV", loop_id="TIC101")


def _minutes() -> list[int]:
    """Minutes of the demo record; the archive is silent strictly between 23:00 and 23:40."""
    return [i for i in range(601) if not 180 < i < 220]


def flow_rows() -> list[tuple]:
    rng, out = np.random.default_rng(42), []
    for i in _minutes():
        value, quality = 62 + 0.8 * math.sin(2 * math.pi * i / 240) + rng.normal(0, 0.15), "GOOD"
        if 360 < i < 390:
            value = 100.0
        elif rng.random() < 0.002:
            quality = "SENSOR DRIFT"
        out.append((i, value, quality))
    return out


def temperature_rows() -> list[tuple]:
    rng, out = np.random.default_rng(7), []
    for i, flow, _ in flow_rows():
        value = 120 + 0.5 * (flow - 62) + rng.normal(0, 0.1)
        if i >= 480:
            value += rng.normal(0, 2)
        out.append((i, value, "GOOD"))
    return out


def demo(spark: SparkSession) -> DataFrame:
    rows = [("demo", p, k, T0 + timedelta(minutes=i), float(v), q) for p, made in (("FIC101.PV", flow_rows()), ("TIC101.PV", temperature_rows())) for k, (i, v, q) in enumerate(made)]
    return spark.createDataFrame(rows, SCHEMA)


def trial_plan() -> switchback.Plan:
    return switchback.make_plan(datetime(2024, 6, 3, tzinfo=UTC), datetime(2024, 6, 4, tzinfo=UTC), 3600, 900, 7)


def lag_response(u: np.ndarray, tau: float) -> np.ndarray:
    """First-order response of unit steps, from 0."""
    out, s = np.zeros(len(u)), 0.0
    for i, x in enumerate(u):
        s += (x - s) * (1 - math.exp(-1 / tau))
        out[i] = s
    return out


def trial_columns() -> dict[str, np.ndarray]:
    rng, n = np.random.default_rng(2024), 3 * 1440
    feed = 40 + np.cumsum(rng.normal(0, 0.05, n))
    hours = np.arange(n) / 60
    ambient = 15 + 6 * np.sin(2 * np.pi * (hours - 9) / 24) + rng.normal(0, 0.2, n)
    shocks, ar, x = rng.normal(0, 0.05, n), np.zeros(n), 0.0
    for i in range(n):
        x = 0.95 * x + shocks[i]
        ar[i] = x
    blocks = trial_plan().blocks
    u = np.zeros(n)
    for b, s in enumerate(blocks):
        if s == "B":
            u[2880 + 60 * b : 2880 + 60 * (b + 1)] = 1
    outlet = 180 + 0.8 * (feed - 40) + 0.1 * (ambient - 15) + 0.25 * lag_response(u, 5) + ar
    return {"feed": feed.round(4), "ambient": ambient.round(4), "outlet": outlet.round(4)}


def trial(spark: SparkSession) -> DataFrame:
    """ts, value (outlet), feed, ambient."""
    c = trial_columns()
    rows = [(TRIAL0 + timedelta(minutes=i), float(c["outlet"][i]), float(c["feed"][i]), float(c["ambient"][i])) for i in range(len(c["feed"]))]
    return spark.createDataFrame(rows, "ts timestamp, value double, feed double, ambient double")


def backbone(spark: SparkSession, seed: int = 42, loops: int = 4, hours: int = 48, rate_s: int = 60) -> tuple[DataFrame, DataFrame]:
    """Samples (with ``state`` on MODE tags) of control loops with one planted fault each, and the truth table."""
    rng, n = np.random.default_rng(seed), hours * 3600 // rate_s
    start, rows, truth = datetime(2025, 1, 1, tzinfo=UTC), [], []
    faults = ("level_shift", "drift", "stuck_sensor", "variance_burst")
    at = lambda i: start + timedelta(seconds=int(i) * rate_s)
    for loop in range(loops):
        block = np.arange(n) * rate_s // (4 * 3600) % 3
        sp = np.array([40.0, 55.0, 70.0])[block]
        pv, x = np.zeros(n), 40.0
        for i in range(n):
            x += 0.15 * (sp[i] - x)
            pv[i] = x
        pv = pv + rng.normal(0, 0.6, n)
        a, b, kind = n // 2, min(n, n // 2 + 240), faults[loop % 4]
        if kind == "level_shift":
            pv[a:b] += 8
        elif kind == "drift":
            pv[a:b] += np.linspace(0, 8, b - a)
        elif kind == "stuck_sensor":
            pv[a:b] = pv[a]
        else:
            pv[a:b] += rng.normal(0, 4, b - a)
        gone = set(rng.choice(n, n // 500, replace=False).tolist())
        source, name = f"sim-unit-{loop}", f"FIC00{loop}"
        rows += [(source, f"{name}.PV", i, at(i), float(pv[i]), None, "GOOD") for i in range(n) if i not in gone]
        rows += [(source, f"{name}.SP", i, at(i), float(sp[i]), None, "GOOD") for i in range(n)]
        rows += [(source, f"{name}.MODE", i, at(i), None, f"R{block[i]}", "GOOD") for i in range(n)]
        truth.append((kind, name, at(a), at(b - 1), 8.0 if loop % 4 < 2 else 4.0))
    samples = spark.createDataFrame(rows, "source_id string, point_id string, row_ix long, ts timestamp, value double, state string, quality string")
    return samples, spark.createDataFrame(truth, "fault_type string, loop string, start timestamp, end timestamp, magnitude double")
