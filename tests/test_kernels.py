"""Kernels against plain definitions and published figures."""

import hashlib
import math
from datetime import UTC, datetime

import numpy as np
import pytest

from sensorloom import contract, errors
from sensorloom.functions import evaluation, provenance, splits, units
from sensorloom.functions.quality import annotate, severity, unmapped
from sensorloom.operators import baselines, compare, features, mspc, physics, segments, switchback
from pyspark.sql import functions as F


def test_contract_digest():
    assert contract.SamplingContract().digest().startswith("d59d433d9c62")
    with pytest.raises(errors.IncomparableSampling):
        contract.require_comparable(contract.SamplingContract(), contract.SamplingContract("EVENT_WEIGHTED"))


def test_meta_is_closed():
    good = {"identity": {"source_id": "a", "point_id": "b"}, "name": "n", "eng_range_zero": 0, "eng_range_span": 1}
    assert contract.meta_from_dict(good).eng_span == 1
    for bad in ({"nam": "x"}, {"eng_range_span": None}, {"sample_rate_s": -1}, {"role": "XX"}, {"quality_codes": {"1": "FINE"}}):
        with pytest.raises(errors.SchemaError):
            contract.meta_from_dict(good | bad)


@pytest.mark.parametrize("code,want,open_", [
    ("0", "GOOD", False), ("10813440", "GOOD", False), ("1", "UNCERTAIN", True), ("192", "UNCERTAIN", True), ("1073741824", "UNCERTAIN", False), ("2147483648", "BAD", False), ("-5", "BAD", False),
    ("257", "BAD", False), ("250.0", "UNCERTAIN", False), ("1d", "UNCERTAIN", True), (" comm failure ", "BAD", False), ("substituted", "UNCERTAIN", False), (None, "UNCERTAIN", True), ("3072", "GOOD", False),
])
def test_severity(spark, code, want, open_):
    r = spark.createDataFrame([(code,)], "q string").select(severity(F.col("q")), unmapped(F.col("q"))).first()
    assert (r[0], r[1]) == (want, open_)


def test_declared_codes(spark):
    df = spark.createDataFrame([("9", {"9": "GOOD"}), (" ok ", {"OK": "GOOD"}), ("x", {"OK": "GOOD"})], "q string, c map<string,string>")
    assert [r[0] for r in df.select(severity(F.col("q"), F.col("c"))).collect()] == ["GOOD", "GOOD", "UNCERTAIN"]


def _samples(spark, rows):
    return spark.createDataFrame([("s", "p", i, datetime.fromtimestamp(t, UTC), v, "GOOD") for i, (t, v) in enumerate(rows)], "source_id string, point_id string, row_ix long, ts timestamp, value double, quality string")


def test_time_and_event_weights(spark):
    rows = [(0, 50.0), *((3540 + 3 * i, 100.0) for i in range(20)), (3600, 50.0)]
    a = annotate(_samples(spark, rows))
    assert physics.time_weighted_mean(a).first()["tw_mean"] == pytest.approx(50.83, abs=0.01)
    assert physics.event_weighted_mean(a).first()["event_mean"] == pytest.approx(95.45, abs=0.01)


def test_gaps(spark):
    s = _samples(spark, [(0, 1.0), (3, 1.0), (600, 1.0), (603, 1.0)])
    g = physics.gaps(s).collect()
    assert [(r["duration_s"], r["class"]) for r in g] == [(597.0, "unknown")]
    assert physics.monotonic_refusals(_samples(spark, [(0, 1.0), (5, 1.0), (3, 1.0)])).first()["error_type"] == "NonMonotonicIndex"


def test_empty_window_is_one_gap(spark):
    s = _samples(spark, [])
    a, b = datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 2, tzinfo=UTC)
    bounds = spark.createDataFrame([("s", "p", a, b)], "source_id string, point_id string, start timestamp, end timestamp")
    g = physics.gaps(s, bounds=bounds)
    assert [r["class"] for r in g.collect()] == ["unknown"]
    assert physics.coverage(g, bounds).first()["coverage"] == 0.0


def _brute(values, penalty, least):
    n = len(values)
    cost = lambda a, b: float(((values[a:b] - values[a:b].mean()) ** 2).sum()) + penalty
    best = {0: (-penalty, [])}
    for end in range(least, n + 1):
        best[end] = min((best[a][0] + cost(a, end), best[a][1] + [a]) for a in best if end - a >= least)
    return [a for a in best[n][1] if a]


def test_change_points_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        v = np.concatenate([rng.normal(m, 1, int(rng.integers(8, 25))) for m in rng.normal(0, 3, 3)])
        assert segments.change_points(v, 6.0, 5) == _brute(v, 6.0, 5)
    v = np.concatenate([rng.normal(0, 1, 1800), rng.normal(2, 1, 1800)])
    assert len(segments.change_points(v, segments.default_penalty(3600), 10)) == 1


def test_runs(spark):
    a = annotate(_samples(spark, [(i, float(v)) for i, v in enumerate([1, 2, 2, 2, 3, 3])])).where("valid")
    r = features.longest_constant_run(a).first()
    assert (r["value"], r["n"]) == (2.0, 3)
    line = [(i, float(v)) for i, v in enumerate([1] * 9 + [-1] + [1] * 10)]
    charted = annotate(_samples(spark, line)).withColumns({"center": F.lit(0.0), "ucl": F.lit(3.0), "lcl": F.lit(-3.0)})
    assert [r["row_ix"] for r in baselines.run_of_nine(charted).collect()] == [8, 18]
    rising = annotate(_samples(spark, [(i, float(i)) for i in range(8)])).withColumns({"center": F.lit(0.0), "ucl": F.lit(3.0), "lcl": F.lit(-3.0)})
    assert sorted(r["row_ix"] for r in baselines.trend_of_six(rising).collect()) == [5, 6, 7]


def test_pca_matches_svd(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(datetime.fromtimestamp(i, UTC), *map(float, r)) for i, r in enumerate(x)], "ts timestamp, a double, b double, c double, d double")
    m = mspc.fit(df, list("abcd"), variance=0.8)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    k = len(m.loadings)
    t = z @ vt[:k].T
    t2 = (t**2 / (s[:k] ** 2 / 199)).sum(1)
    spe = ((z - t @ vt[:k]) ** 2).sum(1)
    got = sorted((r["ts"], r["t2"], r["spe"]) for r in mspc.score(df, m).collect())
    assert np.allclose([g[1] for g in got], t2) and np.allclose([g[2] for g in got], spe)
    assert m.t2_limit == pytest.approx(np.quantile(t2, 0.99)) and m.spe_limit == pytest.approx(np.quantile(spe, 0.99))


def test_designs():
    assert switchback.settings(switchback.make_design(24, 7).observed) == "AAABBABAABBBBBBAAAAABBAB"
    with pytest.raises(errors.DesignTooSmall):
        switchback.make_design(4, 1)
    plan = switchback.make_plan(datetime(2024, 6, 3, tzinfo=UTC), datetime(2024, 6, 4, tzinfo=UTC), 3600, 900, 7)
    assert switchback.verify_plan(plan.document(), plan.digest()) == plan
    with pytest.raises(errors.ScheduleMismatch):
        switchback.verify_plan(plan.document(), "0" * 64)


def test_block_space_equals_row_space():
    rng = np.random.default_rng(5)
    design = switchback.make_design(12, 3)
    block = np.repeat(np.arange(12), 30)
    x = rng.normal(size=(360, 2))
    y = 0.7 * design.observed[block] + x @ [1.0, -2.0] + rng.normal(0, 0.3, 360)
    x, y = x - x.mean(0), y - np.median(y)
    n, sy = np.bincount(block).astype(float), np.bincount(block, y)
    sx = np.column_stack([np.bincount(block, x[:, j]) for j in range(2)])
    r = switchback.analyze(np.column_stack([n, sy]), 1.0, design, sx, x.T @ x, x.T @ y)
    z = np.column_stack([design.observed[block], np.ones(360), x])
    assert r.estimate == pytest.approx(np.linalg.lstsq(z, y, rcond=None)[0][0])
    assert r.p <= 0.05 and r.low <= r.estimate <= r.high


def test_conformal_by_hand(spark):
    assert evaluation.conformal_online(np.array([1, 2, 3, 4]), np.array([2.5, 5, 6])) == pytest.approx([0.6, 1 / 6, 1 / 7], abs=1e-3)
    cal = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "score double")
    st = spark.createDataFrame([(0, 2.5), (1, 5.0), (2, 4.0)], "idx int, score double")
    assert [r["p"] for r in evaluation.conformal_offline(cal, st).orderBy("idx").collect()] == [0.6, 0.2, 0.4]


def test_ranking(spark):
    df = spark.createDataFrame([("r", 0, 0.1), ("r", 0, 0.4), ("r", 1, 0.35), ("r", 1, 0.8)], "k string, label int, score double")
    r = evaluation.ranking_metrics(df, ["k"]).first()
    assert r["auc"] == 0.75 and r["ap"] == pytest.approx(0.8333, abs=1e-4)


def test_group_folds():
    counts = [("A", "s", 2), ("B", "s", 1), ("C", "s", 3)]
    folds = splits.group_holdout(counts, 2)
    assert folds["C"] != folds["A"] and folds["A"] == folds["B"]
    assert splits.largest_remainder(10, (0.7, 0.15, 0.15)) == [7, 2, 1]


def test_bootstrap_order():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=(50, 3))
    a = compare.bootstrap_deltas(x, y, 200)
    assert a.shape == (200, 3, 3) and np.array_equal(a, compare.bootstrap_deltas(x, y, 200))


def test_units():
    assert units.convert(212, "degF", "degC") == pytest.approx(100)
    with pytest.raises(errors.IncomparableUnits):
        units.check_comparable("m3/h", "Nm3/h")
    with pytest.raises(errors.UnresolvedUnit):
        units.check_comparable("m3/h", "furlong")


def test_replay():
    r = provenance.make_record("n", "d", "code", {"x": 1})
    assert provenance.replay(provenance.Record.from_json(r.to_json()), "d", {"x": 1}) == "MATCH"
    assert provenance.replay(r, "e", {"x": 2}) == "BOTH"
    assert hashlib.sha256(b"code").hexdigest() == r.code and math.isfinite(1.0)


def test_segments_equal_the_plain_dynamic_program():
    from sensorloom.operators.segments import change_points

    def cost(v, at, penalty):
        ends = [0, *at, len(v)]
        return sum(float(((v[a:b] - v[a:b].mean()) ** 2).sum()) for a, b in zip(ends, ends[1:], strict=False)) + penalty * len(at)

    def best(v, penalty, least):
        least_cost = [0.0 - penalty] + [np.inf] * len(v)
        for end in range(least, len(v) + 1):
            least_cost[end] = min(least_cost[a] + float(((v[a:end] - v[a:end].mean()) ** 2).sum()) + penalty for a in range(end - least + 1))
        return least_cost[-1]

    rng = np.random.default_rng(5)
    for _ in range(60):
        n, least, penalty = int(rng.integers(24, 60)), int(rng.integers(2, 12)), float(rng.uniform(0.3, 8))
        v = rng.normal(size=n) + np.repeat(rng.normal(0, 2, n // 7 + 1), 7)[:n]
        at = change_points(v, penalty, least)
        assert cost(v, at, penalty) == pytest.approx(best(v, penalty, least))
        assert all(b - a >= least for a, b in zip([0, *at], [*at, n], strict=True))


def test_exact_rejection_by_hand():
    from sensorloom.operators import switchback

    rng, k = np.random.default_rng(3), 6
    n, y = np.full(k, 40.0), rng.normal(size=k) * 40
    s, q = switchback.projected(n, np.zeros((k, 0)), np.zeros((0, 0)), y, np.zeros(0))
    z = switchback.all_assignments(k).astype(float)
    effect = np.abs([y[row == 1].mean() - y[row == 0].mean() for row in z])
    want = np.mean([(effect >= e - 1e-9).mean() <= 0.05 for e in effect])
    assert switchback.exact_rejection(n, s, q, 1.0) == pytest.approx(want)
    assert switchback.exact_rejection(n, s, q, 1.0, 0.2) == pytest.approx(np.mean([(effect >= e - 1e-9).mean() <= 0.2 for e in effect]))


def test_gram_of_many_tags(spark):
    x = np.random.default_rng(4).normal(5, 2, (90, mspc.MOST_EXPRESSIONS + 3))
    points = [f"p.{i}" for i in range(x.shape[1])]
    n, mean, cov = mspc.gram(spark.createDataFrame(x.tolist(), ", ".join(f"`{p}` double" for p in points)), points)
    assert n == 90 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    rows = spark.createDataFrame(x.tolist(), ", ".join(f"`{p}` double" for p in points))
    got = {(r["a"], r["b"]): r["corr"] for r in compare.correlations(rows, points).collect()}
    assert got["p.0", "p.1"] == pytest.approx(np.corrcoef(x.T)[0, 1]) and len(got) == len(points) * (len(points) - 1) // 2
    model = mspc.fit(rows, points, 0.8)
    many = mspc.score(rows, model).agg(F.sum("t2"), F.sum("spe")).first()
    old, mspc.MOST_EXPRESSIONS = mspc.MOST_EXPRESSIONS, 100
    try:
        few = mspc.score(rows, model).agg(F.sum("t2"), F.sum("spe")).first()
    finally:
        mspc.MOST_EXPRESSIONS = old
    assert tuple(many) == pytest.approx(tuple(few))
