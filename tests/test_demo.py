"""The demo archives give the published figures."""

from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.functions.quality import annotate
from sensorloom.operators import baselines, compare, features, mspc, physics, segments, switchback
from sensorloom.sources import fixtures

UTC_AT = lambda d, h, m=0: datetime(2024, 3, d, h, m, tzinfo=UTC)


@pytest.fixture(scope="module")
def rows(spark):
    return annotate(fixtures.demo(spark)).cache()


@pytest.fixture(scope="module")
def flow(rows):
    return rows.where("point_id = 'FIC101.PV'")


def test_profile(spark, flow):
    c = physics.severity_counts(flow).first()
    assert (c["n"], c["n_good"]) == (562, 561)
    s = flow.drop("severity")
    ends = s.groupBy("source_id", "point_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    g = physics.gaps(s, bounds=ends, rate_s=60.0)
    assert [r["duration_s"] for r in g.collect()] == [2400.0]
    assert physics.coverage(g, ends).first()["coverage"] == pytest.approx(0.933, abs=5e-4)
    assert physics.clipping(s, F.lit(0.0), F.lit(100.0)).first()["clipped_fraction"] == pytest.approx(0.0516, abs=5e-5)
    q = features.order_statistics(flow).first()
    assert (round(q["p05"], 2), round(q["p50"], 2), round(q["p95"], 2)) == (61.20, 62.32, 100.0)
    r = features.longest_constant_run(flow.where("valid")).first()
    assert (r["n"], r["duration_s"]) == (29, 28 * 60)


def _split(flow):
    valid = flow.where("valid")
    return valid.where(F.col("ts") < F.lit(UTC_AT(31, 1))), valid.where(F.col("ts") >= F.lit(UTC_AT(31, 1)))


def test_screen_and_chart(flow):
    base, monitor = _split(flow)
    b = baselines.mad_baseline(base)
    r = b.first()
    assert (r["n"], round(r["center"], 2), round(r["scale"], 4)) == (261, 62.32, 0.5488)
    flagged = baselines.screen(monitor.where(F.col("ts") < F.lit(UTC_AT(31, 6, 1))), b)
    assert flagged.where("flagged").count() == 29
    charted = baselines.chart(monitor, b)
    assert (baselines.beyond_limits(charted).count(), baselines.run_of_nine(charted).count(), baselines.trend_of_six(charted).count()) == (29, 6, 2)


def test_segments(flow):
    valid = flow.where("valid")
    found = segments.breaks(valid).join(valid, ["source_id", "point_id", "row_ix"]).orderBy("row_ix")
    assert [r["ts"].strftime("%H:%M") for r in found.select("ts").collect()] == ["21:56", "00:10", "02:01", "02:30", "03:57"]
    assert segments.default_penalty(561) == pytest.approx(18.99, abs=0.01)


def test_pca(rows):
    points = ["FIC101.PV", "TIC101.PV"]
    valid = rows.where("valid")
    train, _ = mspc.align(valid, points, UTC_AT(30, 20), UTC_AT(30, 23), 60)
    m = mspc.fit(train, points)
    assert (len(m.loadings), round(m.explained, 4), round(m.t2_limit, 3), round(m.spe_limit, 4)) == (1, 0.9767, 3.759, 0.2859)
    window, _ = mspc.align(valid, points, UTC_AT(31, 4), UTC_AT(31, 6), 60)
    d = mspc.detect(window, m)
    assert (d.where("t2_breach").count(), d.where("spe_breach").count(), d.count()) == (70, 108, 121)


def test_trial(spark):
    plan = fixtures.trial_plan()
    samples = fixtures.trial(spark)
    kept = switchback.kept(switchback.cut_blocks(samples, plan.start, plan.block_s, 24), plan.washout_s)
    assert kept.count() == 1080
    direct = switchback.analyze_samples(samples, plan)
    assert (round(direct.estimate, 4), round(direct.p, 3)) == (0.6024, 0.154)
    adjusted = switchback.analyze_samples(samples, plan, ["feed", "ambient"])
    assert (round(adjusted.estimate, 4), round(adjusted.p, 3)) == (0.2847, 0.001)
    assert adjusted.low < 0.25 < adjusted.high


def test_compare(rows):
    points = ["FIC101.PV", "TIC101.PV"]
    valid = rows.where("valid")
    pair = []
    for a, b in ((UTC_AT(30, 20), UTC_AT(30, 23)), (UTC_AT(31, 4), UTC_AT(31, 6))):
        pair.append(compare.differences(mspc.align(valid, points, a, b, 60, 0.8)[0], points))
    r = compare.pair_intervals(*pair, points).first()
    assert np.isfinite([r["before"], r["after"], r["low"], r["high"]]).all() and r["clears"]


def test_backbone(spark):
    samples, truth = fixtures.backbone(spark)
    assert truth.count() == 4 and samples.where("point_id like '%.PV'").count() == 4 * (2880 - 5)
