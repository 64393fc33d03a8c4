"""The registered queries over the driver's tables, each beside its DuckDB form where SQL has one."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import evaluation, provenance, splits, units
from ..functions.quality import annotate
from ..operators import baselines, compare, features, flatline, isolation, mspc, physics, segments, switchback
from ..sources import events

TAG = physics.TAG
BASE = (datetime(2024, 1, 2, tzinfo=UTC), datetime(2024, 1, 12, tzinfo=UTC))
MONITOR = (datetime(2024, 1, 12, tzinfo=UTC), datetime(2024, 1, 20, tzinfo=UTC))
_B0, _B1, _M1 = "TIMESTAMP '2024-01-02'", "TIMESTAMP '2024-01-12'", "TIMESTAMP '2024-01-20'"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its DuckDB form."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.startswith("WITH") else f"WITH {events.SQL}{sql}"
        return f

    return add


def _samples(spark, sf) -> DataFrame:
    return events.samples(spark, sf)


def _rows(spark, sf) -> DataFrame:
    return annotate(_samples(spark, sf))


def _valid(spark, sf) -> DataFrame:
    return _rows(spark, sf).where("valid")


def _bounds(samples: DataFrame) -> DataFrame:
    """One window per tag: the whole of January."""
    a, b = datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 2, 1, tzinfo=UTC)
    return samples.select(*TAG).distinct().select(*TAG, F.lit(a).alias("start"), F.lit(b).alias("end"))


def _split(valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Baseline and monitor rows; the stamp on the border belongs to the monitor."""
    base = valid.where((F.col("ts") >= F.lit(BASE[0])) & (F.col("ts") < F.lit(BASE[1])))
    return base, physics.window(valid, *MONITOR)


def _periods(rows: DataFrame) -> DataFrame:
    base, monitor = _split(rows)
    return base.withColumn("period", F.lit("before")).unionByName(monitor.withColumn("period", F.lit("after")))


def _r(column, places: int = 6):
    return F.round(column, places)


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: _r(F.col(n)) for n in names})


_US = "epoch_us(ts)"
_DT = f"""d AS (SELECT *, ({_US} - lag({_US}) OVER (PARTITION BY point_id ORDER BY row_ix)) / 1e6 AS dt FROM a),
th AS (SELECT source_id, point_id, median(dt) AS median_dt, CASE WHEN median(dt) IS NULL OR median(dt) = 0 THEN 3600.0 ELSE greatest(2.5 * median(dt), 60.0) END AS threshold FROM d GROUP BY ALL)"""
_GAPS = f"""{_DT},
w AS (SELECT source_id, point_id, epoch_us(TIMESTAMP '2024-01-01') AS w0, epoch_us(TIMESTAMP '2024-02-01') AS w1, min({_US}) AS f, max({_US}) AS l FROM a GROUP BY ALL),
g AS (SELECT source_id, point_id, {_US} AS stop_us, dt AS duration_s, true AS interior FROM d JOIN th USING (source_id, point_id) WHERE dt > threshold
      UNION ALL SELECT source_id, point_id, f, (f - w0) / 1e6, false FROM w JOIN th USING (source_id, point_id) WHERE (f - w0) / 1e6 > threshold
      UNION ALL SELECT source_id, point_id, w1, (w1 - l) / 1e6, false FROM w JOIN th USING (source_id, point_id) WHERE (w1 - l) / 1e6 > threshold),
gc AS (SELECT *, CASE WHEN duration_s <= 2700 THEN 'sparse_by_design' ELSE 'unknown' END AS class FROM g)"""
_V = "v AS (SELECT * FROM a WHERE valid)"
_BASE = f"""{_V}, b AS (SELECT * FROM v WHERE ts >= {_B0} AND ts < {_B1}), m AS (SELECT * FROM v WHERE ts BETWEEN {_B1} AND {_M1}),
c0 AS (SELECT source_id, point_id, count(*) AS n, median(value) AS center FROM b GROUP BY ALL),
bl AS (SELECT source_id, point_id, any_value(n) AS n, any_value(center) AS center, 1.4826 * median(abs(value - center)) AS scale FROM b JOIN c0 USING (source_id, point_id) GROUP BY ALL)"""
_CHART = f"{_BASE}, ch AS (SELECT m.*, center, center + 3 * scale AS ucl, center - 3 * scale AS lcl FROM m JOIN bl USING (source_id, point_id))"
_RUNS = f"""{_V}, x AS (SELECT *, lag(value) OVER w AS prev FROM v WINDOW w AS (PARTITION BY point_id ORDER BY row_ix)),
y AS (SELECT *, sum(CASE WHEN prev IS NULL OR value <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY point_id ORDER BY row_ix) AS run FROM x),
z AS (SELECT source_id, point_id, run, first(value ORDER BY row_ix) AS value, min(ts) AS t0, max(ts) AS t1, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s FROM y GROUP BY ALL)"""


@query("SELECT point_id, row_ix, severity, unmapped FROM a")
def q_severity(spark, sf):
    return _rows(spark, sf).select("point_id", "row_ix", "severity", "unmapped")


@query("SELECT source_id, point_id, count(*) AS n, count(*) FILTER (severity = 'GOOD') AS n_good, count(*) FILTER (severity = 'UNCERTAIN') AS n_uncertain, count(*) FILTER (severity = 'BAD') AS n_bad FROM a GROUP BY ALL")
def q_severity_counts(spark, sf):
    return physics.severity_counts(_rows(spark, sf))


@query("SELECT source_id, point_id, round(avg(valid::INT), 6) AS valid_fraction FROM a GROUP BY ALL")
def q_valid_fraction(spark, sf):
    return _round(physics.valid_fraction(_rows(spark, sf)), "valid_fraction")


@query("SELECT source_id, point_id, coalesce(quality, '<null>') AS quality, count(*) AS n FROM a WHERE unmapped GROUP BY ALL")
def q_unmapped_codes(spark, sf):
    return physics.unmapped_codes(_rows(spark, sf))


@query("""SELECT source_id, point_id, count(*) AS n, count(*) FILTER (coalesce(raw_value >= 150 - 1.5e-7 OR raw_value <= 1.5e-7, false) OR range_state) AS n_clipped,
round(count(*) FILTER (coalesce(raw_value >= 150 - 1.5e-7 OR raw_value <= 1.5e-7, false) OR range_state) / count(*), 6) AS clipped_fraction,
count(*) FILTER (coalesce(raw_value >= 150 - 1.5e-7 OR raw_value <= 1.5e-7, false) OR range_state) > 0 AS censored FROM a GROUP BY ALL""")
def q_clipping(spark, sf):
    return _round(physics.clipping(_samples(spark, sf), F.lit(events.ENG_ZERO), F.lit(events.ENG_SPAN)), "clipped_fraction")


@query(f"""SELECT source_id, point_id, count(*) AS n, count(*) FILTER (back) AS n_backwards, (SELECT count(*) FROM (SELECT 1 FROM a q WHERE q.point_id = t.point_id GROUP BY ts HAVING count(*) > 1)) AS n_duplicate_stamps
FROM (SELECT *, ts < lag(ts) OVER (PARTITION BY point_id ORDER BY row_ix) AS back FROM a) t GROUP BY ALL""")
def q_stamp_audit(spark, sf):
    return physics.stamp_audit(_samples(spark, sf))


@query(f", {_DT} SELECT source_id, point_id, round(median_dt, 6) AS median_dt, round(threshold, 6) AS threshold FROM th")
def q_thresholds(spark, sf):
    return _round(physics.thresholds(_samples(spark, sf)), "median_dt", "threshold")


def _gap_rows(spark, sf):
    s = _samples(spark, sf)
    return physics.gaps(s, bounds=_bounds(s), rate_s=events.RATE_S)


@query(f", {_GAPS} SELECT point_id, stop_us, round(duration_s, 6) AS duration_s, interior, class FROM gc")
def q_gaps(spark, sf):
    return _gap_rows(spark, sf).select("point_id", F.unix_micros("end").alias("stop_us"), _r(F.col("duration_s")).alias("duration_s"), "interior", "class")


@query(f", {_GAPS} SELECT point_id, class, count(*) AS n, round(sum(duration_s), 3) AS total_s FROM gc GROUP BY ALL")
def q_gap_classes(spark, sf):
    return _gap_rows(spark, sf).groupBy("point_id", "class").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("duration_s"), 3).alias("total_s"))


@query(f""", {_GAPS} SELECT w.source_id, w.point_id, count(gc.class) AS n_gaps, round(max(duration_s), 6) AS longest_gap_s,
round(greatest(0.0, least(1.0, (any_value(w1 - w0) / 1e6 - coalesce(sum(duration_s) FILTER (class = 'unknown'), 0.0)) / (any_value(w1 - w0) / 1e6))), 6) AS coverage FROM w LEFT JOIN gc USING (source_id, point_id) GROUP BY ALL""")
def q_coverage(spark, sf):
    s = _samples(spark, sf)
    bounds = _bounds(s)
    return _round(physics.coverage(physics.gaps(s, bounds=bounds, rate_s=events.RATE_S), bounds), "longest_gap_s", "coverage")


@query(f", {_GAPS} SELECT source_id, point_id, round(CASE WHEN (f - w0) / 1e6 <= threshold THEN (f - w0) / 1e6 END, 6) AS edge_slack_start, round(CASE WHEN (w1 - l) / 1e6 <= threshold THEN (w1 - l) / 1e6 END, 6) AS edge_slack_end FROM w JOIN th USING (source_id, point_id)")
def q_edge_slack(spark, sf):
    s = _samples(spark, sf)
    return _round(physics.edge_slack(s, _bounds(s)), "edge_slack_start", "edge_slack_end")


@query(f""", {_V}, t AS (SELECT *, greatest(0.0, (coalesce(lead({_US}) OVER (PARTITION BY point_id ORDER BY row_ix), {_US}) - {_US}) / 1e6) AS w FROM v)
SELECT source_id, point_id, round(sum(value * w) / sum(w), 6) AS tw_mean FROM t GROUP BY ALL""")
def q_tw_mean(spark, sf):
    return _round(physics.time_weighted_mean(_rows(spark, sf)), "tw_mean")


@query(f", {_V} SELECT source_id, point_id, round(avg(value), 6) AS event_mean FROM v GROUP BY ALL")
def q_event_mean(spark, sf):
    return _round(physics.event_weighted_mean(_rows(spark, sf)), "event_mean")


@query(f""", {_V}, c AS (SELECT point_id, median(value) AS med FROM v GROUP BY ALL), e AS (SELECT point_id, median(abs(value - med)) AS mad FROM v JOIN c USING (point_id) GROUP BY ALL),
x AS (SELECT *, value <> lag(value) OVER (PARTITION BY point_id ORDER BY row_ix) AS ch FROM v),
st AS (SELECT point_id, (epoch_us(max(ts)) - epoch_us(coalesce(max(ts) FILTER (ch), min(ts)))) / 1e6 AS stall_s, count(*) FILTER (ch) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9) AS cph FROM x GROUP BY ALL),
n AS (SELECT source_id, point_id, count(*) AS n, count(*) FILTER (valid) AS n_good FROM a GROUP BY ALL),
s2 AS (SELECT point_id, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi, count(DISTINCT value) AS di FROM v GROUP BY ALL)
SELECT source_id, point_id, n, n_good, round(mean, 6) AS mean, round(sd, 6) AS std, lo AS "min", hi AS "max", di AS "distinct", round(med, 6) AS median, round(mad, 6) AS mad, round(stall_s, 6) AS stall_s, round(cph, 4) AS changes_per_hour
FROM n JOIN s2 USING (point_id) JOIN c USING (point_id) JOIN e USING (point_id) JOIN st USING (point_id)""")
def q_features(spark, sf):
    f = _round(features.features(_rows(spark, sf)), "mean", "std", "median", "mad", "stall_s")
    return f.withColumn("changes_per_hour", F.round("changes_per_hour", 4))


@query(f""", {_V}, {_DT}, p AS (SELECT source_id, point_id, quantile_cont(value, [0.05, 0.5, 0.95]) AS q FROM v GROUP BY ALL), r AS (SELECT point_id, quantile_cont(dt, [0.05, 0.5, 0.95]) AS q2 FROM d GROUP BY ALL)
SELECT source_id, point_id, round(q[1], 6) AS p05, round(q[2], 6) AS p50, round(q[3], 6) AS p95, round(q2[1], 6) AS dt_p05, round(q2[2], 6) AS dt_p50, round(q2[3], 6) AS dt_p95 FROM p JOIN r USING (point_id)""")
def q_intervals(spark, sf):
    return _round(features.order_statistics(_rows(spark, sf)), "p05", "p50", "p95", "dt_p05", "dt_p50", "dt_p95")


@query(f", {_DT} SELECT source_id, point_id, round(median_dt, 6) AS median_dt, NOT (median_dt BETWEEN 450 AND 1800) AS mismatch FROM th")
def q_rate_mismatch(spark, sf):
    return _round(features.rate_mismatch(_samples(spark, sf), F.lit(events.RATE_S)), "median_dt")


def _modes(spark, sf) -> DataFrame:
    s = _samples(spark, sf)
    return s.select("source_id", F.concat("point_id", F.lit(".MODE")).alias("point_id"), "row_ix", "ts", F.concat(F.lit("R"), F.floor(F.hour("ts") / 8)).alias("state"), F.col("point_id").alias("of"))


@query("SELECT source_id, point_id || '.MODE' AS point_id, 'R' || (hour(ts) // 8) AS state, count(*) AS n FROM s GROUP BY ALL")
def q_state_counts(spark, sf):
    return features.state_counts(_modes(spark, sf))


@query(f", {_RUNS} SELECT source_id, point_id, value, epoch_us(t0) AS start_us, n, round(duration_s, 6) AS duration_s FROM z QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY duration_s DESC, n DESC, t0) = 1")
def q_constant_run(spark, sf):
    f = features.longest_constant_run(_valid(spark, sf))
    return f.select(*TAG, "value", F.unix_micros("start").alias("start_us"), "n", _r(F.col("duration_s")).alias("duration_s"))


@query(f""", {_V}, x AS (SELECT *, value <> lag(value) OVER (PARTITION BY point_id ORDER BY row_ix) AS ch FROM v), y AS (SELECT *, (({_US}) - lag({_US}) OVER (PARTITION BY point_id ORDER BY row_ix)) / 1e6 AS iv FROM x WHERE ch)
SELECT source_id, point_id, count(*) AS n, round(max(iv), 6) AS longest, round(quantile_cont(iv, 0.99), 6) AS p99 FROM y WHERE iv IS NOT NULL GROUP BY ALL""")
def q_change_intervals(spark, sf):
    return features.change_intervals(_valid(spark, sf)).groupBy(*TAG).agg(F.count(F.lit(1)).alias("n"), _r(F.max("interval_s")).alias("longest"), _r(F.percentile("interval_s", F.lit(0.99))).alias("p99"))


@query(f""", {_V}, t AS (SELECT *, min({_US}) OVER (PARTITION BY point_id) AS t0 FROM v), k AS (SELECT *, floor(({_US} - t0) / 1e6 / 86400)::BIGINT AS bucket, ceil((epoch_us({_M1}) - t0) / 1e6 / 86400)::BIGINT - 1 AS m FROM t),
e AS (SELECT source_id, point_id, unnest(range(0, max(m))) AS bucket FROM k GROUP BY source_id, point_id), g AS (SELECT point_id, bucket, count(*) AS n, count(DISTINCT value) AS di FROM k WHERE bucket < m GROUP BY ALL)
SELECT source_id, point_id, bucket, coalesce(n, 0) AS n, coalesce(di, 0) AS "distinct" FROM e LEFT JOIN g USING (point_id, bucket)""")
def q_reference_windows(spark, sf):
    return features.reference_windows(_valid(spark, sf), 86400.0, F.lit(MONITOR[1]))


@query(f""", {_BASE}, x AS (SELECT *, value <> lag(value) OVER (PARTITION BY point_id ORDER BY row_ix) AS ch FROM m),
st AS (SELECT source_id, point_id, (epoch_us(max(ts)) - epoch_us(coalesce(max(ts) FILTER (ch), min(ts)))) / 1e6 AS stall_s, count(DISTINCT value) AS n_distinct FROM x GROUP BY ALL),
h AS (SELECT *, floor(({_US} - min({_US}) OVER (PARTITION BY point_id)) / 1e6 / 691200)::BIGINT AS bk, ceil((epoch_us({_B1}) - min({_US}) OVER (PARTITION BY point_id)) / 1e6 / 691200)::BIGINT - 1 AS nm FROM (SELECT * FROM v WHERE ts < {_B1})),
h2 AS (SELECT *, value <> lag(value) OVER (PARTITION BY point_id, bk ORDER BY row_ix) AS ch FROM h WHERE bk < nm),
h3 AS (SELECT point_id, ({_US} - lag({_US}) OVER (PARTITION BY point_id, bk ORDER BY row_ix)) / 1e6 AS iv FROM h2 WHERE ch),
p AS (SELECT point_id, quantile_cont(iv, 0.99) AS stall_p99 FROM h3 WHERE iv IS NOT NULL GROUP BY ALL), q AS (SELECT point_id, quantile_cont(di, 0.05) AS distinct_p05 FROM (SELECT point_id, bk, count(DISTINCT value) AS di FROM h2 GROUP BY ALL) GROUP BY ALL)
SELECT source_id, point_id, round(stall_s, 6) AS stall_s, round(stall_p99, 6) AS stall_p99, n_distinct, round(distinct_p05, 6) AS distinct_p05, CASE WHEN stall_s > stall_p99 OR n_distinct < distinct_p05 THEN 'FLATLINE' ELSE 'OK' END AS verdict
FROM st JOIN p USING (point_id) JOIN q USING (point_id)""")
def q_flatline(spark, sf):
    rows = _rows(spark, sf)
    window, past = physics.window(rows, *MONITOR), rows.where(F.col("ts") < F.lit(BASE[1]))
    span = (MONITOR[1] - MONITOR[0]).total_seconds()
    return _round(flatline.assess(window, past, span, F.lit(BASE[1])), "stall_s", "stall_p99", "distinct_p05").drop("reason")


@query(f", {_BASE} SELECT source_id, point_id, n, round(center, 6) AS center, round(scale, 6) AS scale FROM bl")
def q_mad_baseline(spark, sf):
    return _round(baselines.mad_baseline(_split(_valid(spark, sf))[0]), "center", "scale")


@query(f", {_BASE}, s2 AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY point_id ORDER BY row_ix)) AS st FROM b) SELECT source_id, point_id, count(value) AS n, round(median(value), 6) AS center, round(avg(st) / 1.128, 6) AS scale FROM s2 GROUP BY ALL")
def q_moving_range(spark, sf):
    return _round(baselines.moving_range_baseline(_split(_valid(spark, sf))[0]), "center", "scale")


def _screened(spark, sf, k: float = 1.5) -> DataFrame:
    base, monitor = _split(_valid(spark, sf))
    usable, _ = baselines.split(baselines.mad_baseline(base), baselines.LEAST_ROWS, "screen")
    return baselines.screen(monitor, usable, k)


_SCREEN = f"{_BASE}, sc AS (SELECT m.*, value < center - 1.5 * scale OR value > center + 1.5 * scale AS flagged FROM m JOIN bl USING (source_id, point_id) WHERE n >= 30 AND scale > 0)"


@query(f", {_SCREEN} SELECT point_id, row_ix, value, flagged FROM sc")
def q_screen(spark, sf):
    return _screened(spark, sf).select("point_id", "row_ix", "value", "flagged")


@query(f", {_SCREEN}, r AS (SELECT *, sum((NOT flagged)::INT) OVER (PARTITION BY point_id ORDER BY row_ix) AS run FROM sc) SELECT source_id, point_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM r WHERE flagged GROUP BY source_id, point_id, run")
def q_flag_runs(spark, sf):
    r = features.flag_runs(_screened(spark, sf), "flagged")
    return r.select(*TAG, F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def _regimes(spark, sf) -> DataFrame:
    """Every tag's values with the mode of its source at the same stamp; a stamp seen more than once has one mode."""
    modes = _modes(spark, sf).select("source_id", F.col("of").alias("point_id"), "ts", "state").distinct()
    return _valid(spark, sf).join(modes.withColumnRenamed("state", "regime"), [*TAG, "ts"])


_REG = f"""{_V}, rg AS (SELECT *, 'R' || (hour(ts) // 8) AS regime FROM v), rb AS (SELECT * FROM rg WHERE ts >= {_B0} AND ts < {_B1}),
rc AS (SELECT source_id, point_id, regime, count(*) AS n, median(value) AS center FROM rb GROUP BY ALL),
rl AS (SELECT source_id, point_id, regime, any_value(n) AS n, any_value(center) AS center, 1.4826 * median(abs(value - center)) AS scale FROM rb JOIN rc USING (source_id, point_id, regime) GROUP BY ALL)"""


@query(f", {_REG} SELECT source_id, point_id, regime, n, round(center, 6) AS center, round(scale, 6) AS scale FROM rl")
def q_regime_baselines(spark, sf):
    return _round(baselines.regime_baselines(_split(_regimes(spark, sf))[0]), "center", "scale")


@query(f", {_REG} SELECT rg.point_id, row_ix, rg.regime, value < center - 1.5 * scale OR value > center + 1.5 * scale AS flagged FROM rg JOIN rl USING (source_id, point_id, regime) WHERE ts BETWEEN {_B1} AND {_M1}")
def q_regime_screen(spark, sf):
    base, monitor = _split(_regimes(spark, sf))
    return baselines.screen_regime(monitor, baselines.regime_baselines(base), 1.5).select("point_id", "row_ix", "regime", "flagged")


def _days(spark, sf) -> DataFrame:
    """A window per tag and day, with its distinct count and stall; the source is the asset."""
    v = _valid(spark, sf).withColumn("day", F.to_date("ts"))
    w = Window.partitionBy(*TAG, "day").orderBy("row_ix")
    v = v.withColumn("ch", F.coalesce(F.col("value") != F.lag("value").over(w), F.lit(False)))
    turn = F.coalesce(F.max(F.when(F.col("ch"), F.col("ts"))), F.min("ts"))
    return v.groupBy(F.col("source_id").alias("asset"), F.col("point_id").alias("variable"), "day").agg(F.count_distinct("value").alias("distinct"), physics.seconds(F.max("ts"), turn).alias("stall_s"))


_DAYS = f"""{_V}, dy AS (SELECT *, ts::DATE AS day, value <> lag(value) OVER (PARTITION BY point_id, ts::DATE ORDER BY row_ix) AS ch FROM v),
dw AS (SELECT source_id AS asset, point_id AS variable, day, count(DISTINCT value) AS di, (epoch_us(max(ts)) - epoch_us(coalesce(max(ts) FILTER (ch), min(ts)))) / 1e6 AS stall_s FROM dy GROUP BY ALL),
pb AS (SELECT asset, variable, count(*) AS n, quantile_cont(di, 0.05) AS distinct_p05, quantile_cont(di, 0.5) AS distinct_p50, quantile_cont(stall_s, 0.95) AS stall_p95, quantile_cont(stall_s, 0.5) AS stall_p50, count(*) FILTER (di <= 1) AS n_frozen FROM dw GROUP BY ALL)"""


@query(f", {_DAYS} SELECT asset, variable, n, round(distinct_p05, 6) AS distinct_p05, round(distinct_p50, 6) AS distinct_p50, round(stall_p95, 6) AS stall_p95, round(stall_p50, 6) AS stall_p50, n_frozen FROM pb")
def q_population(spark, sf):
    return _round(features.population_baseline(_days(spark, sf)), "distinct_p05", "distinct_p50", "stall_p95", "stall_p50")


@query(f", {_DAYS} SELECT asset, variable, day::VARCHAR AS day, CASE WHEN n < 20 THEN 'refused' WHEN di <= 1 AND distinct_p05 > 1 THEN 'indicted' WHEN di <= 1 THEN 'frozen' ELSE 'ok' END AS verdict FROM dw JOIN pb USING (asset, variable)")
def q_population_screen(spark, sf):
    days = _days(spark, sf)
    return baselines.screen_population(days, features.population_baseline(days)).select("asset", "variable", F.col("day").cast("string").alias("day"), "verdict")


def _charted(spark, sf) -> DataFrame:
    base, monitor = _split(_valid(spark, sf))
    return baselines.chart(monitor, baselines.mad_baseline(base))


@query(f", {_CHART} SELECT point_id, row_ix FROM ch WHERE value > ucl OR value < lcl")
def q_spc_beyond(spark, sf):
    return baselines.beyond_limits(_charted(spark, sf)).select("point_id", "row_ix")


_ISLANDS = """, i1 AS (SELECT *, {sign} AS sg FROM ch), i2 AS (SELECT *, CASE WHEN sg IS NOT DISTINCT FROM lag(sg) OVER (PARTITION BY point_id ORDER BY row_ix) AND lag(row_ix) OVER (PARTITION BY point_id ORDER BY row_ix) IS NOT NULL THEN 0 ELSE 1 END AS nw FROM i1),
i3 AS (SELECT *, sum(nw) OVER (PARTITION BY point_id ORDER BY row_ix) AS run FROM i2), i4 AS (SELECT *, row_number() OVER (PARTITION BY point_id, run ORDER BY row_ix) AS place FROM i3)"""


@query(f", {_CHART}{_ISLANDS.format(sign='sign(value - center)')} SELECT point_id, row_ix FROM i4 WHERE place = 9 AND sg <> 0")
def q_spc_run9(spark, sf):
    return baselines.run_of_nine(_charted(spark, sf)).select("point_id", "row_ix")


@query(f", {_CHART}{_ISLANDS.format(sign='sign(value - lag(value) OVER (PARTITION BY point_id ORDER BY row_ix))')} SELECT point_id, row_ix FROM i4 WHERE place >= 5 AND sg <> 0")
def q_spc_trend6(spark, sf):
    return baselines.trend_of_six(_charted(spark, sf)).select("point_id", "row_ix")


@query(f""", {_V}, g AS (SELECT *, (row_number() OVER (PARTITION BY point_id, ts::DATE ORDER BY row_ix) - 1) // 5 AS grp FROM v), e AS (SELECT source_id, point_id, ts::DATE AS day, grp, avg(value) AS xb, max(value) - min(value) AS r FROM g GROUP BY ALL HAVING count(*) = 5),
t AS (SELECT source_id, point_id, count(*) AS n_groups, avg(xb) AS xbar, avg(r) AS rbar FROM e GROUP BY ALL), lo AS (SELECT source_id, point_id, sum(c % 5)::BIGINT AS n_left FROM (SELECT source_id, point_id, ts::DATE AS day, count(*) AS c FROM v GROUP BY ALL) GROUP BY ALL)
SELECT source_id, point_id, 5::BIGINT AS n, n_groups, n_left, round(xbar, 6) AS xbar, round(xbar - 0.577 * rbar, 6) AS xbar_lcl, round(xbar + 0.577 * rbar, 6) AS xbar_ucl, round(rbar, 6) AS rbar, round(0.0 * rbar, 6) AS r_lcl, round(2.114 * rbar, 6) AS r_ucl FROM t JOIN lo USING (source_id, point_id)""")
def q_xbar_r(spark, sf):
    """All consecutive subgroups of five of a tag and day; n_left counts the rows of incomplete last groups."""
    v = _valid(spark, sf).withColumn("day", F.to_date("ts"))
    return _round(baselines.xbar_r_whole(v, 5, "day"), "xbar", "xbar_lcl", "xbar_ucl", "rbar", "r_lcl", "r_ucl")


@query()
def q_segment(spark, sf):
    t = segments.segment_table(_valid(spark, sf))
    return t.select(*TAG, "segment", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", _r(F.col("median")).alias("median"), _r(F.col("mad")).alias("mad"))


@query()
def q_mode_labels(spark, sf):
    v = _valid(spark, sf)
    return segments.mode_rows(v, segments.breaks(v)).groupBy(*TAG, "state").agg(F.count(F.lit(1)).alias("n"))


_POINTS = ["click", "error", "purchase", "signup", "view"]


def _grid(spark, sf) -> DataFrame:
    """Twelve-hour means of the values by event type; most cells are filled at every size of the table."""
    v = _samples(spark, sf).withColumn("ts", F.timestamp_micros((F.floor(F.unix_micros("ts") / 43_200_000_000) * 43_200_000_000).cast("long")))
    return v.groupBy("source_id", "point_id", "ts").agg(F.avg("value").alias("value"))


def _aligned(spark, sf) -> DataFrame:
    return mspc.align(_grid(spark, sf), _POINTS, datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 30, 12, tzinfo=UTC), 43200, 0.8)[0]


_GRID = """gr AS (SELECT point_id, (epoch_us(ts) // 43200000000) * 43200000000 AS us, avg(value) AS value FROM s GROUP BY ALL),
al AS (SELECT us, max(value) FILTER (point_id = 'click') AS click, max(value) FILTER (point_id = 'error') AS error, max(value) FILTER (point_id = 'purchase') AS purchase, max(value) FILTER (point_id = 'signup') AS signup, max(value) FILTER (point_id = 'view') AS view
       FROM gr GROUP BY us HAVING count(DISTINCT point_id) = 5 AND us BETWEEN epoch_us(TIMESTAMP '2024-01-01') AND epoch_us(TIMESTAMP '2024-01-30 12:00:00')),
df AS (SELECT * FROM (SELECT us, click - lag(click) OVER o AS click, error - lag(error) OVER o AS error, purchase - lag(purchase) OVER o AS purchase, signup - lag(signup) OVER o AS signup, view - lag(view) OVER o AS view FROM al WINDOW o AS (ORDER BY us)) WHERE click IS NOT NULL)"""


@query(f", {_GRID} SELECT us, round(click, 6) AS click, round(error, 6) AS error, round(purchase, 6) AS purchase, round(signup, 6) AS signup, round(view, 6) AS view FROM al")
def q_grid_align(spark, sf):
    return _round(_aligned(spark, sf), *_POINTS).select(F.unix_micros("ts").alias("us"), *_POINTS)


@query()
def q_mspc_t2spe(spark, sf):
    rows = _aligned(spark, sf)
    model = mspc.fit(rows.where(F.col("ts") < F.lit(BASE[1])), _POINTS, variance=0.8)
    return mspc.detect(rows.where(F.col("ts") >= F.lit(BASE[1])), model).withColumns({"t2": _r(F.col("t2")), "spe": _r(F.col("spe"))})


_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM {{t}}" for i, a in enumerate(_POINTS) for b in _POINTS[i + 1 :])


@query(f", {_GRID} {_PAIRS.format(t='df')}")
def q_pair_corr(spark, sf):
    return _round(compare.correlations(compare.differences(_aligned(spark, sf), _POINTS), _POINTS), "corr")


@query(f", {_GRID}, rk AS (SELECT {', '.join(f'rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2 AS {p}' for p in _POINTS)} FROM df) {_PAIRS.format(t='rk')}")
def q_pair_spearman(spark, sf):
    return _round(compare.correlations(compare.ranks(compare.differences(_aligned(spark, sf), _POINTS), _POINTS), _POINTS), "corr")


def _halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = _aligned(spark, sf)
    half = lambda a, b: compare.differences(rows.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))), _POINTS)
    return half(*BASE), half(*MONITOR)


@query()
def q_pair_bootstrap(spark, sf):
    return _round(compare.pair_intervals(*_halves(spark, sf), _POINTS), "before", "after", "delta", "low", "high")


@query()
def q_joint(spark, sf):
    rows = _aligned(spark, sf)
    got = compare.joint_structure(rows.where(F.col("ts") < F.lit(BASE[1])), rows.where(F.col("ts") >= F.lit(BASE[1])), _POINTS)
    return spark.createDataFrame([(r.period, round(r.kept, 6), round(r.other, 6)) for r in got.itertuples()], "period string, kept double, other double")


_PER = f"""{_V}, pr AS (SELECT *, CASE WHEN ts < {_B1} THEN 'before' ELSE 'after' END AS period FROM v WHERE ts >= {_B0} AND ts <= {_M1}), pm AS (SELECT source_id, point_id, period, median(value) AS med FROM pr GROUP BY ALL),
pd AS (SELECT source_id, point_id, period, any_value(med) AS med, median(abs(value - med)) AS mad FROM pr JOIN pm USING (source_id, point_id, period) GROUP BY ALL),
x AS (SELECT source_id, point_id, max(med) FILTER (period = 'before') AS m0, max(med) FILTER (period = 'after') AS m1, max(mad) FILTER (period = 'before') AS d0, max(mad) FILTER (period = 'after') AS d1 FROM pd GROUP BY ALL)"""


@query(f", {_PER} SELECT source_id, point_id, round((m1 - m0) / (1.4826 * d0), 6) AS shift, round(d1 / d0, 6) AS spread_ratio FROM x")
def q_level_shift(spark, sf):
    return _round(compare.level_and_spread(_periods(_valid(spark, sf))), "shift", "spread_ratio")


@query(f", {_BASE} SELECT source_id, point_id, round(avg((value < center - 3 * scale OR value > center + 3 * scale)::INT), 6) AS flagged FROM m JOIN bl USING (source_id, point_id) GROUP BY ALL")
def q_flagged_share(spark, sf):
    return _round(compare.flagged_share(_periods(_valid(spark, sf))), "flagged")


@query()
def q_changed_at(spark, sf):
    return compare.changed_at(_periods(_valid(spark, sf)), MONITOR[0]).select(*TAG, F.unix_micros("changed_at").alias("changed_us"))


_PLAN = switchback.make_plan(datetime(2024, 1, 12, tzinfo=UTC), datetime(2024, 1, 20, tzinfo=UTC), 8 * 3600, 3600, 7)


@query(f""", {_V}, k AS (SELECT *, (epoch_us(ts) - epoch_us({_B1})) AS u FROM v WHERE ts >= {_B1} AND ts < {_M1})
SELECT point_id, (u // 28800000000)::INT AS block, count(*) AS n, round(sum(value), 6) AS sy FROM k WHERE u % 28800000000 >= 3600000000 GROUP BY ALL""")
def q_block_sums(spark, sf):
    rows = switchback.kept(switchback.cut_blocks(_valid(spark, sf), _PLAN.start, _PLAN.block_s, len(_PLAN.blocks)), _PLAN.washout_s)
    return rows.groupBy("point_id", "block").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("value")).alias("sy"))


@query()
def q_switchback(spark, sf):
    got = switchback.analyze_samples(_valid(spark, sf).select("ts", "value"), _PLAN)
    return spark.createDataFrame([tuple(round(float(x), 6) for x in (got.estimate, got.p, got.low, got.high))], "estimate double, p double, low double, high double")


@query(f""", {_BASE}, cal AS (SELECT point_id, value AS score FROM b), st AS (SELECT point_id, row_ix, value AS score FROM m)
SELECT st.point_id, row_ix, round(((SELECT count(*) FROM cal WHERE cal.score >= st.score) + 1) / ((SELECT count(*) FROM cal) + 1), 9) AS p FROM st""")
def q_conformal_offline(spark, sf):
    base, monitor = _split(_valid(spark, sf))
    got = evaluation.conformal_offline(base.select(F.col("value").alias("score")), monitor.select("point_id", "row_ix", F.col("value").alias("score")))
    return got.select("point_id", "row_ix", F.round("p", 9).alias("p"))


@query(f", {_V}, p AS (SELECT point_id, row_ix, (value + 1) / 500 AS p FROM v) SELECT point_id, row_ix, round(sum(ln(0.5) - 0.5 * ln(p)) OVER (PARTITION BY point_id ORDER BY row_ix), 6) AS log_m FROM p")
def q_martingale(spark, sf):
    v = _valid(spark, sf).withColumn("p", (F.col("value") + 1) / 500)
    return _round(evaluation.power_martingale(v, 0.5, TAG, "row_ix"), "log_m").select("point_id", "row_ix", "log_m")


_MIX = ", ".join(f"n * ln({e}) + ({e} - 1) * s" for e in evaluation.EPSILONS)


@query(f""", {_V}, p AS (SELECT point_id, row_ix, count(*) OVER w AS n, sum(ln((value + 1) / 500)) OVER w AS s FROM v WINDOW w AS (PARTITION BY point_id ORDER BY row_ix)), l AS (SELECT point_id, row_ix, [{_MIX}] AS l FROM p)
SELECT point_id, row_ix, round(list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l)))) / 9), 6) AS log_m FROM l""")
def q_mixture_martingale(spark, sf):
    v = _valid(spark, sf).withColumn("p", (F.col("value") + 1) / 500)
    return _round(evaluation.mixture_martingale(v, TAG, "row_ix"), "log_m").select("point_id", "row_ix", "log_m")


def _labelled(spark, sf) -> DataFrame:
    return _samples(spark, sf).select("source_id", F.round("value", 1).alias("score"), (F.col("point_id") == "error").cast("int").alias("label"))


_RANK = """lb AS (SELECT round(value, 1) AS score, (point_id = 'error')::INT AS label FROM s), e AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM lb GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM e WINDOW w AS (ORDER BY score DESC))"""


@query(f", {_RANK} SELECT 'events' AS source_id, round(sum(neg * (tp - pos + pos / 2)) / any_value(ap * an), 9) AS auc, round(sum(pos / ap * tp / (tp + fp)), 9) AS ap, round(max(tp / (tp + fp)) FILTER (tp >= 0.8 * ap), 9) AS precision_at FROM c")
def q_ranking_auc(spark, sf):
    return evaluation.ranking_metrics(_labelled(spark, sf), ["source_id"]).select("source_id", *(F.round(c, 9).alias(c) for c in ("auc", "ap", "precision_at")))


@query(f", {_RANK} SELECT score, round(tp / (tp + fp), 9) AS precision, round(tp / ap, 9) AS recall FROM c")
def q_pr_curve(spark, sf):
    return evaluation.precision_recall(_labelled(spark, sf), ["source_id"]).select("score", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("""WITH r AS (SELECT point_id, row_ix, row_number() OVER (PARTITION BY point_id ORDER BY h, row_ix) AS k, count(*) OVER (PARTITION BY point_id) AS n FROM (SELECT event_type AS point_id, event_id AS row_ix, sha256('42:' || event_type || '|' || event_id) AS h FROM events)),
f AS (SELECT *, floor(n * 0.7 + 1e-9)::BIGINT AS a, floor(n * 0.15 + 1e-9)::BIGINT AS b FROM r), g AS (SELECT *, n - a - 2 * b AS rest, n * 0.7 - a AS ra, n * 0.15 - b AS rb FROM f),
h AS (SELECT *, a + CASE WHEN rest >= 1 AND ra >= rb THEN 1 WHEN rest >= 3 THEN 1 ELSE 0 END AS tr, CASE WHEN ra >= rb THEN CASE WHEN rest >= 2 THEN 1 ELSE 0 END ELSE CASE WHEN rest >= 1 THEN 1 ELSE 0 END END AS xb FROM g)
SELECT point_id, row_ix, CASE WHEN k <= tr THEN 'train' WHEN k <= tr + b + xb THEN 'val' ELSE 'test' END AS fold FROM h""")
def q_stratified_split(spark, sf):
    return splits.stratified_split(_samples(spark, sf), "point_id", "row_ix").select("point_id", "row_ix", "fold")


@query()
def q_group_folds(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_nationkey").cast("string").alias("nation"), "c_mktsegment")
    return splits.group_folds(c, "nation", "c_mktsegment", 5).groupBy("fold", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT point_id, row_ix, sha256(epoch_us(ts)::VARCHAR || chr(10) || round(value * 1e9)::HUGEINT::VARCHAR || chr(10) || coalesce(quality, 'null')) AS hash FROM s")
def q_row_hash(spark, sf):
    return _samples(spark, sf).select("point_id", "row_ix", provenance.row_hash(F.col("ts"), F.col("value"), F.col("quality")).alias("hash"))


_LANES = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(8))


@query(f"""SELECT source_id, point_id, count(*) AS n, sha256(concat_ws('|', count(*)::VARCHAR, {_LANES})) AS fingerprint
FROM (SELECT *, sha256(epoch_us(ts)::VARCHAR || chr(10) || round(value * 1e9)::HUGEINT::VARCHAR || chr(10) || coalesce(quality, 'null')) AS h FROM s) GROUP BY ALL""")
def q_fingerprint(spark, sf):
    return provenance.fingerprint(_samples(spark, sf), TAG)


@query("""SELECT source_id, point_id, epoch_us(ts) + CASE WHEN x = 2 THEN 1 ELSE 0 END AS us, CASE x WHEN 0 THEN 'removed' WHEN 1 THEN 'changed' ELSE 'added' END AS change
FROM (SELECT *, unnest(CASE WHEN row_ix % 100 = 0 THEN [0] WHEN row_ix % 100 = 1 THEN [1] WHEN row_ix % 100 = 2 THEN [2] ELSE [] END) AS x FROM s)""")
def q_replay_diff(spark, sf):
    s = _samples(spark, sf)
    k = F.col("row_ix") % 100
    after = s.where(k != 0).withColumn("value", F.when(k == 1, F.col("value") + 1).otherwise(F.col("value")))
    after = after.unionByName(s.where(k == 2).withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + 1)))
    d = provenance.diff_frames(s, after, TAG, ("row_ix",))
    return d.select(*TAG, F.unix_micros("ts").alias("us"), "change")


@query(f", {_GRID} SELECT us, point_id, round(value, 6) AS value FROM al UNPIVOT (value FOR point_id IN (click, error, purchase, signup, view))")
def q_wide_unpivot(spark, sf):
    wide = _aligned(spark, sf)
    return wide.unpivot(["ts"], _POINTS, "point_id", "value").select(F.unix_micros("ts").alias("us"), "point_id", _r(F.col("value")).alias("value"))


@query("""WITH u(unit_raw, canonical, dimension, reference_condition) AS (VALUES ('m3/h', 'cubic meters per hour', 'volume flow', false), (' BAR ', 'bar', 'pressure', false), ('DEGC', 'degrees Celsius', 'temperature', false), ('Nm3/h', 'normal cubic meters per hour', 'volume flow', true), ('furlong', NULL, NULL, NULL))
SELECT r_regionkey, unit_raw, canonical, dimension, reference_condition FROM (SELECT r_regionkey, ['m3/h', ' BAR ', 'DEGC', 'Nm3/h', 'furlong'][r_regionkey % 5 + 1] AS unit_raw FROM region) LEFT JOIN u USING (unit_raw)""")
def q_units(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ("m3/h", " BAR ", "DEGC", "Nm3/h", "furlong"))), (F.col("r_regionkey") % 5 + 1).cast("int"))
    return units.resolve(spark.read.parquet(f"{sf}/region.parquet").select("r_regionkey", raw.alias("unit_raw")))


def _account(spark, sf):
    """Every tag's January: its rows and the account of its window."""
    rows = _samples(spark, sf)
    bounds = _bounds(rows)
    tags = bounds.select(*TAG, F.lit(events.RATE_S).alias("sample_rate_s"), F.lit(events.ENG_ZERO).alias("eng_zero"), F.lit(events.ENG_SPAN).alias("eng_span"))
    return *physics.read_window(rows, bounds, tags), bounds


_CLIP = "coalesce(raw_value >= 150 - 1.5e-7 OR raw_value <= 1.5e-7, false) OR range_state"
_COVER = """cv AS (SELECT w.source_id, w.point_id, count(gc.class) AS n_gaps, greatest(0.0, least(1.0, (any_value(w1 - w0) / 1e6 - coalesce(sum(duration_s) FILTER (class = 'unknown'), 0.0)) / (any_value(w1 - w0) / 1e6))) AS coverage
FROM w LEFT JOIN gc USING (source_id, point_id) GROUP BY ALL)"""


@query(f""", {_GAPS}, {_COVER}, n AS (SELECT source_id, point_id, count(*) AS n, count(*) FILTER (severity = 'GOOD') AS n_good, count(*) FILTER (severity = 'BAD') AS n_bad, count(*) FILTER ({_CLIP}) AS n_clipped,
round(avg(valid::INT), 6) AS valid_fraction, count(DISTINCT coalesce(quality, '<null>')) FILTER (unmapped) AS n_unmapped_codes, bool_and(coalesce(TRY_CAST(quality AS BIGINT) BETWEEN 0 AND 255, false)) FILTER (unmapped) AS byte_sized_codes FROM a GROUP BY ALL)
SELECT source_id, point_id, n, n_good, n_bad, n_clipped, valid_fraction, n_unmapped_codes, coalesce(byte_sized_codes, false) AS byte_sized_codes, n_gaps, n_gaps AS n_listed, round(coverage, 6) AS coverage FROM n JOIN cv USING (source_id, point_id)""")
def q_read_window(spark, sf):
    account = _account(spark, sf)[1].withColumn("n_unmapped_codes", F.size("unmapped_codes").cast("long")).withColumn("n_listed", F.size(F.coalesce("gaps", F.array())).cast("long"))
    return _round(account, "coverage", "valid_fraction").select(*TAG, "n", "n_good", "n_bad", "n_clipped", "valid_fraction", "n_unmapped_codes", "byte_sized_codes", "n_gaps", "n_listed", "coverage")


_OFF = (datetime(2024, 1, 10, tzinfo=UTC), datetime(2024, 1, 14, tzinfo=UTC))


@query(f""", {_GAPS}, gs AS (SELECT *, stop_us - CASE WHEN interior THEN round(duration_s * 1e6)::BIGINT ELSE 0 END AS from_us FROM g),
ge AS (SELECT source_id, point_id, duration_s, interior, CASE WHEN interior THEN from_us WHEN stop_us = w1 THEN l ELSE w0 END AS a, stop_us AS b FROM gs JOIN w USING (source_id, point_id)),
o AS (SELECT *, point_id IN ('click', 'error') AND a >= epoch_us(TIMESTAMP '2024-01-10') AND b <= epoch_us(TIMESTAMP '2024-01-14') AS is_off,
        EXISTS (SELECT 1 FROM ge x WHERE x.source_id = ge.source_id AND x.point_id <> ge.point_id AND x.a < ge.b AND x.b > ge.a) AS is_peer FROM ge)
SELECT point_id, CASE WHEN is_off THEN 'scan_off' WHEN is_peer THEN 'comm_outage' WHEN duration_s <= 2700 THEN 'sparse_by_design' ELSE 'unknown' END AS class, count(*) AS n, round(sum(duration_s), 3) AS total_s FROM o GROUP BY ALL""")
def q_gap_outages(spark, sf):
    s = _samples(spark, sf)
    bounds = _bounds(s)
    off = bounds.where("point_id in ('click', 'error')").select(*TAG, F.lit(_OFF[0]).alias("start"), F.lit(_OFF[1]).alias("end"))
    found = physics.gaps(s, bounds=bounds, rate_s=events.RATE_S, off=off, peers=True)
    return found.groupBy("point_id", "class").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("duration_s"), 3).alias("total_s"))


@query(f""", {_V}, {_GAPS}, {_COVER}, c AS (SELECT point_id, median(value) AS med FROM v GROUP BY ALL), e AS (SELECT point_id, median(abs(value - med)) AS mad FROM v JOIN c USING (point_id) GROUP BY ALL),
x AS (SELECT *, value <> lag(value) OVER (PARTITION BY point_id ORDER BY row_ix) AS ch, (coalesce(lead({_US}) OVER (PARTITION BY point_id ORDER BY row_ix), {_US}) - {_US}) / 1e6 AS wt FROM v),
st AS (SELECT point_id, (epoch_us(max(ts)) - epoch_us(coalesce(max(ts) FILTER (ch), min(ts)))) / 1e6 AS stall_s, count(*) FILTER (ch) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9) AS cph, sum(value * greatest(0.0, wt)) / sum(greatest(0.0, wt)) AS tw FROM x GROUP BY ALL),
n AS (SELECT source_id, point_id, count(*) AS n, count(*) FILTER (valid) AS n_good, count(*) FILTER ({_CLIP}) AS k, count(DISTINCT coalesce(quality, '<null>')) FILTER (unmapped) AS codes FROM a GROUP BY ALL),
s2 AS (SELECT point_id, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi, count(DISTINCT value) AS di FROM v GROUP BY ALL)
SELECT source_id || ':' || point_id AS tag, n AS n_samples, n_good, round(coverage, 6) AS coverage, round(tw, 6) AS weighted_mean, round(sd, 6) AS std, round(lo, 6) AS "min", round(hi, 6) AS "max", round(med, 6) AS median, round(mad, 6) AS mad, di AS distinct_count,
round(stall_s, 0) AS stall_s, round(cph, 4) AS changes_per_hour, round(k / n, 6) AS clipped_fraction, k > 0 AS censored, codes AS unmapped_quality_codes
FROM n JOIN s2 USING (point_id) JOIN c USING (point_id) JOIN e USING (point_id) JOIN st USING (point_id) JOIN cv USING (source_id, point_id)""")
def q_window_features(spark, sf):
    f = features.extract(*_account(spark, sf))
    f = f.drop("window_start", "window_end", "notes").withColumn("unmapped_quality_codes", F.col("unmapped_quality_codes").cast("long"))
    return _round(f, "coverage", "clipped_fraction")


@query(f""", {_REG}, seen AS (SELECT DISTINCT source_id, point_id, regime FROM rg WHERE ts BETWEEN {_B1} AND {_M1} AND regime = 'R2')
SELECT 'screen' AS step, source_id || ':' || point_id || ':' || regime AS tags, 'RegimeTooSparse' AS error_type, 'the history never shows this regime' AS cause FROM seen""")
def q_regime_refusals(spark, sf):
    base, monitor = _split(_regimes(spark, sf))
    history = baselines.regime_baselines(base).where("regime <> 'R2'").withColumns({"n": F.lit(100).cast("long"), "scale": F.lit(1.0)})
    return baselines.regime_refusals(monitor, history)


@query(f""", {_PER}, fz AS (SELECT point_id, quantile_cont(iv, 0.99) AS p99 FROM (SELECT point_id, ({_US} - lag({_US}) OVER (PARTITION BY point_id ORDER BY row_ix)) / 1e6 AS iv FROM
  (SELECT *, value <> lag(value) OVER (PARTITION BY point_id ORDER BY row_ix) AS ch FROM pr WHERE period = 'before') WHERE ch) WHERE iv IS NOT NULL GROUP BY ALL),
fa AS (SELECT point_id, (epoch_us(max(ts)) - epoch_us(coalesce(max(ts) FILTER (ch), min(ts)))) / 1e6 AS stall_s FROM (SELECT *, value <> lag(value) OVER (PARTITION BY point_id ORDER BY row_ix) AS ch FROM pr WHERE period = 'after') GROUP BY ALL),
q AS (SELECT source_id, point_id, p, count(*) AS n, count(*) FILTER (severity = 'GOOD') AS g, count(*) FILTER (severity = 'BAD') AS b FROM (SELECT *, CASE WHEN ts < {_B1} THEN 'before' ELSE 'after' END AS p FROM a WHERE ts >= {_B0} AND ts <= {_M1}) GROUP BY ALL),
qq AS (SELECT source_id, point_id, max(g / n) FILTER (p = 'before') AS g0, max(g / n) FILTER (p = 'after') AS g1, max(n) FILTER (p = 'after') AS n1, max(b) FILTER (p = 'after') AS b1 FROM q GROUP BY ALL),
r AS (SELECT source_id, point_id, CASE WHEN n1 IS NULL THEN 'no rows' WHEN g1 < coalesce(g0, 1) - 0.05 THEN 'fell' WHEN stall_s > p99 THEN 'frozen' ELSE 'ok' END AS verdict, (m1 - m0) / (1.4826 * d0) AS shift FROM qq LEFT JOIN x USING (source_id, point_id) LEFT JOIN fz USING (point_id) LEFT JOIN fa USING (point_id))
SELECT source_id, point_id, verdict, round(shift, 6) AS shift, row_number() OVER (ORDER BY (verdict = 'ok') DESC, abs(shift) DESC NULLS LAST, source_id, point_id) AS rank FROM r""")
def q_compare(spark, sf):
    got = compare.compare(_rows(spark, sf), BASE, MONITOR).tags
    told = F.when(F.col("verdict").rlike("%$"), "fell").otherwise(F.col("verdict"))
    return _round(got, "shift").select(*TAG, told.alias("verdict"), "shift", F.col("rank").cast("long").alias("rank"))


@query(f""", {_V} SELECT source_id, point_id, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 / 21600)::BIGINT AS step, count(*) AS n, min(value) AS low, first({_US} ORDER BY value, ts) AS low_us, max(value) AS high, first({_US} ORDER BY value DESC, ts) AS high_us FROM v GROUP BY ALL""")
def q_thin(spark, sf):
    got = features.thin(_valid(spark, sf), datetime(2024, 1, 1, tzinfo=UTC), 21600)
    return got.select(*TAG, "step", "n", "low", F.unix_micros("low_at").alias("low_us"), "high", F.unix_micros("high_at").alias("high_us"))


@query()
def q_isolation(spark, sf):
    """Anomaly scores of every tag's days."""
    days = _valid(spark, sf).groupBy(*TAG, F.to_date("ts").alias("day")).agg(*(f("value").alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))))
    columns = ["mean", "std", "min", "max"]
    return _round(isolation.score_rows(days, columns, isolation.fit(days, columns)), "score").select(*TAG, F.col("day").cast("string").alias("day"), "score")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Per tag: severities, coverage, gaps, clipping and means, in one table."""
    s = _samples(spark, sf)
    rows, bounds = annotate(s), _bounds(s)
    out = physics.severity_counts(rows).join(physics.coverage(physics.gaps(s, bounds=bounds, rate_s=events.RATE_S), bounds), TAG)
    out = out.join(physics.clipping(s, F.lit(events.ENG_ZERO), F.lit(events.ENG_SPAN)).drop("n"), TAG)
    return out.join(physics.time_weighted_mean(rows), TAG).join(physics.event_weighted_mean(rows), TAG)
