"""What the archive did to each window: gaps, coverage, severities, clipping, stamps.

All operators take a samples table that holds every tag and work by tag in one job. Stored row
order (``row_ix``) is data: nothing is sorted by time behind the caller's back.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TAG = ["source_id", "point_id"]


def by_row():
    """A tag's rows in stored order."""
    return Window.partitionBy(*TAG).orderBy("row_ix")


#: Stored rows of one block are numbered within a power of two of row_ix; a tag's blocks are dealt out one by one.
BLOCK_BITS = 16
#: Tables of one row per tag that are met by broadcast, a few tens of MB; longer ones are met by shuffle.
MAX_TAGS = 100_000


def few(rows: DataFrame, keys: list[str] = TAG) -> bool:
    """Whether ``rows`` have at most ``MAX_TAGS`` keys."""
    return rows.select(*keys).distinct().limit(MAX_TAGS + 1).count() <= MAX_TAGS


def beside(per_tag: DataFrame, is_few: bool) -> DataFrame:
    """A table of one row per tag, to be met by all rows without dealing them by tag where tags are few."""
    return F.broadcast(per_tag) if is_few else per_tag


def neighbour(rows: DataFrame, column: str, out: str, ahead: bool = False) -> DataFrame:
    """Adds ``out``: ``column`` of the row before in a tag's stored order, or after with ``ahead``.

    Blocks of row_ix are sorted one by one; a block's first row gets the last one of the tag's block before.
    Stored numbers that lie far apart give small blocks, and the same answer.
    """
    rows = rows.withColumn("_block", F.shiftright(F.col("row_ix").cast("long"), BLOCK_BITS))
    keys = [*TAG, "_block"]
    within = Window.partitionBy(*keys).orderBy("row_ix")
    step, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    ends = rows.groupBy(*keys).agg(edge(F.col(column), F.col("row_ix")).alias("_edge"))
    ends = ends.select(*keys, step("_edge").over(Window.partitionBy(*TAG).orderBy("_block")).alias("_edge"))
    near = step(F.struct(F.col(column).alias("x"))).over(within)
    found = rows.withColumn("_near", near).join(ends, keys, "left")
    return found.select(*(c for c in rows.columns if c != "_block" and c != out), F.when(F.col("_near").isNull(), F.col("_edge")).otherwise(F.col("_near.x")).alias(out))


def median(rows: DataFrame, value: str, keys: list[str] = TAG, out: str = "median", is_few: bool | None = None) -> DataFrame:
    """keys, out: the exact median of the values that aren't null; null for a key without any.

    Values are counted in narrow ranges of their logarithm; only those in the ranges that hold a key's
    middle ranks are counted one by one. No task holds all values of a key.
    """
    is_few = few(rows, keys) if is_few is None else is_few
    v = F.col("_v")
    part = (F.floor(F.log(F.abs(v)) * LOG_PARTS) + 1000 * LOG_PARTS).cast("long")  # above 0, and rising with abs(v)
    part = F.when(v == 0, F.lit(0)).when(F.isnan(v), F.lit(1 << 62)).when(F.abs(v) == float("inf"), F.signum(v).cast("long") * (1 << 61)).when(v > 0, part).when(v < 0, -part)
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_part", part)
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.groupBy(*keys, "_part").agg(F.count("_v").alias("_k"))
    sizes = sizes.withColumns({"_to": F.sum("_k").over(upto), "_n": F.sum("_k").over(Window.partitionBy(*keys))})
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    # a key without values keeps its one row of the part null
    middle = sizes.where(((F.col("_to") > low) & (F.col("_to") - F.col("_k") <= high) & (F.col("_k") > 0)) | (F.col("_n") == 0))
    middle = middle.select(*keys, "_part", (F.col("_to") - F.col("_k")).alias("_base"), "_n")
    same = lambda a, b, names: [a[k].eqNullSafe(b[f"_m{k}"]) for k in names]
    named = beside(middle.select(*(F.col(k).alias(f"_m{k}") for k in [*keys, "_part"]), "_base", "_n"), is_few)
    met = rows.join(named, same(rows, named, [*keys, "_part"]))
    each = met.groupBy(*keys, "_part", "_v").agg(F.count("_v").alias("_k"), F.first("_base").alias("_base"), F.first("_n").alias("_n"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("_to", F.col("_base") + F.sum("_k").over(inside))
    at = lambda rank: F.min(F.when(F.col("_to") > rank, v))
    a, b = at(low), at(high)
    return each.groupBy(*keys).agg(F.when(a == b, a).otherwise(0.5 * a + 0.5 * b).alias(out))


#: Ranges of a median's values for each factor of e.
LOG_PARTS = 1 << 14
LOST = ("comm_outage", "scan_off", "unknown")
NO_MEDIAN_S = 3600.0


def seconds(later: Column, earlier: Column) -> Column:
    """Difference of two stamps in seconds, exact to the microsecond."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def window(samples: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Rows in the closed interval; the bounds reach the scan."""
    return samples.where(F.col("ts").between(F.lit(start), F.lit(end)))


def intervals(samples: DataFrame) -> DataFrame:
    """Adds dt: seconds since the row before, over all rows whatever their severity."""
    return neighbour(samples, "ts", "_prev").withColumn("dt", seconds(F.col("ts"), F.col("_prev"))).drop("_prev")


def thresholds(samples: DataFrame, is_few: bool | None = None) -> DataFrame:
    """tag, median_dt, threshold: max(2.5 medians, 60 s); 3600 s where the median is null or 0."""
    med = F.col("median_dt")
    rule = F.when(med.isNull() | (med == 0), NO_MEDIAN_S).otherwise(F.greatest(2.5 * med, F.lit(60.0)))
    is_few = few(samples) if is_few is None else is_few
    return median(intervals(samples), "dt", out="median_dt", is_few=is_few).withColumn("threshold", rule)


def classify(duration: Column, interior: Column, median: Column, rate: Column, stepped: Column, off: Column | None = None, peers: Column | None = None) -> Column:
    """scan_off, comm_outage, compression_steady, sparse_by_design, unknown: the first that holds."""
    out = F.when(F.coalesce(off, F.lit(False)), "scan_off") if off is not None else F.when(F.lit(False), "scan_off")
    if peers is not None:
        out = out.when(F.coalesce(peers, F.lit(False)), "comm_outage")
    out = out.when(stepped & interior & (duration <= 50 * median), "compression_steady")
    return out.when((rate > 0) & (duration <= 3 * rate), "sparse_by_design").otherwise("unknown")


def _inside(found: DataFrame, spans: DataFrame) -> DataFrame:
    """The gaps that lie in a span of their tag."""
    named = spans.select(*(F.col(c).alias(f"_{c}") for c in [*TAG, "start", "end"]))
    same = (F.col("source_id") == F.col("_source_id")) & (F.col("point_id") == F.col("_point_id"))
    return found.join(named, same & (F.col("start") >= F.col("_start")) & (F.col("end") <= F.col("_end")), "left_semi")


def shared_holes(found: DataFrame) -> DataFrame:
    """The gaps that overlap a gap of another tag of their source.

    Gaps of one tag never overlap, so it is enough to count: of all gaps of a source, those that
    begin before a gap's end, less those that end by its start, are itself and what it overlaps.
    Both counts run along the sorted ends of a source's gaps; no pair is formed.
    """
    keys = [*TAG, "start", "end"]
    event = lambda at, order, begins, ends, asks: F.struct(F.unix_micros(at).alias("at"), F.lit(order).alias("order"), F.lit(begins).alias("begins"), F.lit(ends).alias("ends"), F.lit(asks).alias("asks"))
    events = F.array(event("end", 0, 0, 0, 1), event("start", 1, 1, 0, 0), event("end", 1, 0, 1, 0), event("start", 2, 0, 0, -1))
    rows = found.select(*keys, F.explode(events).alias("e")).select(*keys, "e.*")
    w = Window.partitionBy("source_id").orderBy("at", "order", "point_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.when(F.col("asks") == 1, F.sum("begins").over(w)).when(F.col("asks") == -1, -F.sum("ends").over(w)))
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 1").select(*keys)


def gaps(samples: DataFrame, tags: DataFrame | None = None, bounds: DataFrame | None = None, stepped: bool = False, rate_s: float | None = None, off: DataFrame | None = None, peers: bool = False, is_few: bool | None = None) -> DataFrame:
    """One row per gap: tag, start, end, duration_s, interior, class.

    bounds: tag, start, end of the window; adds the gaps at its edges, and one over the whole
    window of a tag without rows. tags: tag, sample_rate_s. off: tag, start, end of the periods in
    which scanning is declared off; a gap inside one is its. With ``peers``, a gap that overlaps a
    gap of another tag of its source is an outage of both.
    """
    dt = intervals(samples)
    is_few = few(samples) if is_few is None else is_few
    limit = thresholds(samples, is_few)
    inner = dt.join(beside(limit, is_few), TAG).where("dt > threshold")
    found = inner.select(*TAG, F.timestamp_micros(F.unix_micros("ts") - F.round(F.col("dt") * 1e6).cast("long")).alias("start"), F.col("ts").alias("end"), F.col("dt").alias("duration_s"), F.lit(True).alias("interior"), "median_dt")
    if bounds is not None:
        ends = samples.groupBy(*TAG).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
        edge = bounds.select(*TAG, F.col("start").alias("w0"), F.col("end").alias("w1")).join(ends, TAG, "left").join(limit, TAG, "left").withColumn("threshold", F.coalesce("threshold", F.lit(NO_MEDIAN_S)))
        pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"), seconds(b, a).alias("duration_s"))
        whole = F.array(pair(F.col("w0"), F.col("w1")))
        sides = F.filter(F.array(pair(F.col("w0"), F.col("first")), pair(F.col("last"), F.col("w1"))), lambda x: x["duration_s"] > F.col("threshold"))
        edge = edge.select(*TAG, F.explode(F.when(F.col("first").isNull(), whole).otherwise(sides)).alias("g"), "median_dt", "first")
        found = found.unionByName(edge.select(*TAG, "g.start", "g.end", "g.duration_s", F.lit(False).alias("interior"), "median_dt"))
    rate = F.lit(rate_s).cast("double")
    if tags is not None:
        found = found.join(tags.select(*TAG, "sample_rate_s"), TAG, "left")
        rate = F.col("sample_rate_s")
    keys, is_off, is_peer = [*TAG, "start", "end"], None, None
    if off is not None:
        inside = _inside(found.select(*keys), off.select(*keys))
        found, is_off = found.join(inside.withColumn("_off", F.lit(True)), keys, "left"), F.col("_off")
    if peers:
        found, is_peer = found.join(shared_holes(found.select(*keys)).withColumn("_peer", F.lit(True)), keys, "left"), F.col("_peer")
    kind = classify(F.col("duration_s"), F.col("interior"), F.col("median_dt"), rate, F.lit(stepped), is_off, is_peer)
    return found.select(*TAG, "start", "end", "duration_s", "interior", kind.alias("class"))


def coverage(found: DataFrame, bounds: DataFrame) -> DataFrame:
    """tag, n_gaps, longest_gap_s, coverage: share of the window not lost, null for an empty span."""
    lost = F.sum(F.when(F.col("class").isin(*LOST), F.col("duration_s")))
    total = found.groupBy(*TAG).agg(F.count(F.lit(1)).alias("n_gaps"), F.max("duration_s").alias("longest_gap_s"), lost.alias("lost_s"))
    span = seconds(F.col("end"), F.col("start"))
    share = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (span - F.coalesce("lost_s", F.lit(0.0))) / span)))
    return bounds.join(total, TAG, "left").select(*TAG, F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), "longest_gap_s", share.alias("coverage"))


def edge_slack(samples: DataFrame, bounds: DataFrame, is_few: bool | None = None) -> DataFrame:
    """tag, edge_slack_start, edge_slack_end: seconds at the edges too short to be gaps, else null."""
    ends = samples.groupBy(*TAG).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    both = bounds.join(ends, TAG).join(thresholds(samples, is_few), TAG)
    head, tail = seconds(F.col("first"), F.col("start")), seconds(F.col("end"), F.col("last"))
    return both.select(*TAG, F.when(head <= F.col("threshold"), head).alias("edge_slack_start"), F.when(tail <= F.col("threshold"), tail).alias("edge_slack_end"))


def severity_counts(annotated: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}")
    return annotated.groupBy(*TAG).agg(F.count(F.lit(1)).alias("n"), n("GOOD"), n("UNCERTAIN"), n("BAD"))


def valid_fraction(annotated: DataFrame) -> DataFrame:
    return annotated.groupBy(*TAG).agg((F.count_if("valid") / F.count(F.lit(1))).alias("valid_fraction"))


def unmapped_codes(annotated: DataFrame) -> DataFrame:
    """tag, quality, n for codes that no rule knows."""
    return annotated.where("unmapped").groupBy(*TAG, F.coalesce("quality", F.lit("<null>")).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


def clipping(samples: DataFrame, zero: Column, span: Column) -> DataFrame:
    """tag, n, n_clipped, clipped_fraction, censored: over rows that have a value or a range state."""
    from ..functions.quality import clipped, numeric_code

    flag = clipped(F.col("value"), numeric_code(F.col("quality")), zero, span)
    known = F.max(span).isNotNull()
    total = samples.groupBy(*TAG).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_clipped"), known.alias("range_known"))
    share = F.when(F.col("range_known") & (F.col("n") > 0), F.col("n_clipped") / F.col("n"))
    return total.select(*TAG, "n", "n_clipped", share.alias("clipped_fraction"), F.when(F.col("n_clipped") > 0, True).when(F.col("range_known"), False).alias("censored"))


def stamp_audit(samples: DataFrame) -> DataFrame:
    """tag, n, n_backwards, n_duplicate_stamps (distinct stamps seen more than once)."""
    back = neighbour(samples, "ts", "_prev").withColumn("back", F.col("ts") < F.col("_prev"))
    turns = back.groupBy(*TAG).agg(F.count(F.lit(1)).alias("n"), F.count_if("back").alias("n_backwards"))
    twice = samples.groupBy(*TAG, "ts").count().where("count > 1").groupBy(*TAG).agg(F.count(F.lit(1)).alias("n_duplicate_stamps"))
    return turns.join(twice, TAG, "left").na.fill(0, ["n_duplicate_stamps"])


def monotonic_refusals(samples: DataFrame, step: str = "read") -> DataFrame:
    """Refusal rows for tags whose stamps run backwards."""
    bad = stamp_audit(samples).where("n_backwards > 0")
    return bad.select(F.lit(step).alias("step"), F.concat_ws(":", *TAG).alias("tags"), F.lit("NonMonotonicIndex").alias("error_type"), F.format_string("%d rows run backwards in time", "n_backwards").alias("cause"))


def time_weighted_mean(annotated: DataFrame, end: Column | None = None) -> DataFrame:
    """tag, tw_mean: a GOOD value holds until the next one, the last until ``end``; null where no time passes."""
    good = annotated.where((F.col("severity") == "GOOD") & F.col("value").isNotNull())
    after = F.coalesce(F.col("_next"), end if end is not None else F.col("ts"))
    w = neighbour(good, "ts", "_next", ahead=True).withColumn("w", F.greatest(F.lit(0.0), seconds(after, F.col("ts"))))
    total = F.sum("w")
    return w.groupBy(*TAG).agg(F.when(total > 0, F.sum(F.col("value") * F.col("w")) / total).alias("tw_mean"))


def event_weighted_mean(annotated: DataFrame) -> DataFrame:
    good = annotated.where((F.col("severity") == "GOOD") & F.col("value").isNotNull())
    return good.groupBy(*TAG).agg(F.avg("value").alias("event_mean"))


def read_window(samples: DataFrame, bounds: DataFrame, tags: DataFrame | None = None, stepped: bool = False, off: DataFrame | None = None, peers: bool = False, least: str = "GOOD") -> tuple[DataFrame, DataFrame]:
    """The rows of one window per tag with their severities, and the account of what the store did to them.

    bounds: tag, start, end. tags: tag, and any of sample_rate_s, eng_zero, eng_span, quality_codes.
    The account has one row per tag of ``bounds``, also where no sample is left: n, severity counts,
    valid_fraction, unmapped codes, clipping, stamps, coverage, gaps (array, by their start), edge
    slacks, values beyond single precision, and whether all unmapped codes are byte-sized.
    """
    from ..functions.quality import FLOAT32_MAX, annotate

    known = [c for c in ("sample_rate_s", "eng_zero", "eng_span", "quality_codes") if tags is not None and c in tags.columns]
    is_few = few(bounds)
    rows = samples.join(beside(bounds.select(*TAG, F.col("start").alias("_w0"), F.col("end").alias("_w1")), is_few), TAG).where(F.col("ts").between(F.col("_w0"), F.col("_w1"))).drop("_w0", "_w1")
    if known:
        own = tags.select(*TAG, *known).join(bounds.select(*TAG), TAG, "left_semi")
        rows = rows.join(beside(own, is_few), TAG, "left")
    raw = rows
    rows = annotate(rows, "quality_codes" if "quality_codes" in known else None, least)
    zero, span = (F.col(c) if c in known else F.lit(None).cast("double") for c in ("eng_zero", "eng_span"))
    found = gaps(samples=raw, tags=tags if "sample_rate_s" in known else None, bounds=bounds, stepped=stepped, off=off, peers=peers, is_few=is_few)
    byte = F.col("q_num").between(0, 255)
    more = rows.groupBy(*TAG).agg(
        F.sort_array(F.collect_set(F.when(F.col("unmapped"), F.coalesce("quality", F.lit("<null>"))))).alias("unmapped_codes"),
        F.coalesce(F.bool_and(F.when(F.col("unmapped"), F.coalesce(byte, F.lit(False)))), F.lit(False)).alias("byte_sized_codes"),
        F.count_if(F.abs("value") > FLOAT32_MAX).alias("n_beyond_float32"),
    )
    listed = found.groupBy(*TAG).agg(F.sort_array(F.collect_list(F.struct("start", "end", "duration_s", "interior", "class"))).alias("gaps"))
    out = coverage(found, bounds)
    for part in (severity_counts(rows), valid_fraction(rows), clipping(raw, zero, span).drop("n"), stamp_audit(raw).drop("n"), edge_slack(raw, bounds, is_few), more, listed):
        out = out.join(part, TAG, "left")
    return rows, out.na.fill(0, ["n", "n_good", "n_uncertain", "n_bad", "n_clipped", "n_backwards", "n_duplicate_stamps", "n_beyond_float32"])
