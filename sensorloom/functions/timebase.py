"""Windows, durations, local times and date orders of exports."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from datetime import UTC, datetime, timedelta
from itertools import pairwise
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import SchemaError

_DURATION = re.compile(r"P(?:(\d+(?:\.\d+)?)D)?(?:T(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?")


def parse_duration(text: str) -> timedelta:
    """ISO 8601 days, hours, minutes and seconds; months and years have no fixed length and are refused."""
    m = _DURATION.fullmatch(text)
    if not m or not any(m.groups()):
        raise ValueError(f"{text!r} is no duration of days, hours, minutes and seconds")
    d, h, mi, s = (float(x) if x else 0.0 for x in m.groups())
    return timedelta(days=d, hours=h, minutes=mi, seconds=s)


def parse_bound(text: str) -> datetime:
    """An aware stamp; a bare date is 00:00 UTC."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return datetime.fromisoformat(text).replace(tzinfo=UTC)
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    if at.tzinfo is None:
        raise ValueError(f"{text!r} states no zone")
    return at.astimezone(UTC)


def parse_window(text: str) -> tuple[datetime, datetime]:
    """START/END, START/DURATION, DURATION/END, or one date for its UTC day."""
    parts = text.split("/")
    if len(parts) == 1:
        start = parse_bound(parts[0])
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", parts[0]):
            raise ValueError("a window needs both its ends")
        return start, start + timedelta(days=1)
    if len(parts) != 2:
        raise ValueError(f"{text!r} is no window")
    a, b = parts
    if a.startswith("P"):
        end = parse_bound(b)
        start = end - parse_duration(a)
    else:
        start = parse_bound(a)
        end = start + parse_duration(b) if b.startswith("P") else parse_bound(b)
    if end <= start:
        raise ValueError("a window must end after it starts")
    return start, end


def parse_periods(before: str, after: str) -> tuple[tuple[datetime, datetime], tuple[datetime, datetime]]:
    b, a = parse_window(before), parse_window(after)
    if b[0] < a[1] and a[0] < b[1]:
        raise ValueError("the periods overlap")
    if a[0] < b[0]:
        raise ValueError("the after period must follow the before period")
    return b, a


def validate_zones(names: list[str]) -> None:
    unknown = [n for n in names if n not in available_timezones()]
    if unknown:
        raise ValueError(f"unknown zones: {', '.join(unknown)}")


def dst_transitions(start: datetime, end: datetime, zone: str) -> list[datetime]:
    """UTC instants in (start, end] where the zone's offset changes, to the second.

    No zone changes twice between two midnights of UTC, so the days whose ends differ are searched.
    """
    tz, first, last = ZoneInfo(zone), math.floor(start.timestamp()), math.ceil(end.timestamp())
    offset = lambda second: datetime.fromtimestamp(second, tz).utcoffset()
    days = [first, *range((first // 86400 + 1) * 86400, last, 86400), last]
    turned = [(a, b) for a, b in pairwise(days) if offset(a) != offset(b)]
    at = [a + 1 + bisect_left(range(a + 1, b + 1), True, key=lambda s, a=a: offset(s) != offset(a)) for a, b in turned]
    return [datetime.fromtimestamp(s, UTC) for s in at if start.timestamp() < s <= end.timestamp()]


def offset_refusals(rows: DataFrame, stamp: str, keys: list[str]) -> DataFrame:
    """Refusal rows for tags of which some stamps state an offset and some don't."""
    aware = F.col(stamp).rlike(r"(Z|z|[+-]\d{2}:?\d{2})\s*$")
    mixed = rows.where(F.col(stamp).isNotNull()).groupBy(*keys).agg(F.count_if(aware).alias("aware"), F.count_if(~aware).alias("naive")).where("aware > 0 and naive > 0")
    cause = F.format_string("%d stamps state an offset and %d don't", "aware", "naive")
    return mixed.select(F.lit("parse").alias("step"), F.concat_ws(":", *keys).alias("tags"), F.lit("SchemaError").alias("error_type"), cause.alias("cause"))


def unread_refusals(rows: DataFrame, text: str, stamp: str, keys: list[str]) -> DataFrame:
    """Refusal rows that name the first text, in stored order, which no format reads, and how many there are."""
    bad = rows.where(F.col(text).isNotNull() & F.col(stamp).isNull())
    found = bad.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min_by(text, "row_ix").alias("first"))
    return found.select(F.lit("parse").alias("step"), F.concat_ws(":", *keys).alias("tags"), F.lit("SchemaError").alias("error_type"), F.format_string("%d stamps can't be read, first %s", "n", "first").alias("cause"))


def require_utc(rows: DataFrame, stamp: str = "ts") -> None:
    """A column of instants; naive stamps and other types are refused."""
    kind = dict(rows.dtypes).get(stamp)
    if kind != "timestamp":
        raise SchemaError(f"{stamp} must hold instants, not {kind or 'be missing'}")


def localise(rows: DataFrame, local: str, zone: str, keys: list[str], order: str = "row_ix", out: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Naive local stamps to UTC, and refusal rows.

    The repeated hour in autumn is resolved by row order: the first pass is summer time, and a
    step backwards inside it starts the second. Stamps that the spring change skips are refused.
    """
    naive = F.col(local).cast("timestamp_ntz")
    first = F.to_utc_timestamp(naive.cast("timestamp"), zone)
    hour = F.expr("INTERVAL 1 HOUR")
    back = lambda t: F.from_utc_timestamp(t, zone).cast("timestamp_ntz")
    rows = rows.withColumn("_u", first).withColumn("_skipped", back(F.col("_u")) != naive)
    rows = rows.withColumn("_twice", ~F.col("_skipped") & (back(F.col("_u") + hour) == naive))
    w = Window.partitionBy(*keys).orderBy(order)
    turn = F.col("_twice") & F.coalesce(F.lag("_twice").over(w), F.lit(False)) & (naive < F.lag(naive).over(w))
    rows = rows.withColumn("_day", F.to_date(naive)).withColumn("_pass", turn.cast("int"))
    rows = rows.withColumn("_pass", F.when(F.col("_twice"), F.sum("_pass").over(Window.partitionBy(*keys, "_day").orderBy(order))).otherwise(0))
    out_rows = rows.withColumn(out, F.when(F.col("_pass") > 0, F.col("_u") + hour).otherwise(F.col("_u")))
    bad = rows.where("_skipped or _pass > 1").groupBy(*keys).agg(F.count_if("_skipped").alias("s"), F.count_if(F.col("_pass") > 1).alias("t"))
    cause = F.when(F.col("s") > 0, F.format_string("%d stamps fall into the skipped hour", "s")).otherwise("the repeated hour runs backwards more than once")
    refused = bad.select(F.lit("localise").alias("step"), F.concat_ws(":", *keys).alias("tags"), F.lit("SchemaError").alias("error_type"), cause.alias("cause"))
    return out_rows.drop("_u", "_skipped", "_twice", "_day", "_pass"), refused


_DATE = r"^\s*(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{2})(?:[ T]|$)"


def date_order(rows: DataFrame, stamp: str, day_first: bool | None = None) -> str:
    """'day', 'month' or 'iso' for a whole column, by one aggregate."""
    a = F.regexp_extract(stamp, _DATE, 1).try_cast("int")
    b = F.regexp_extract(stamp, _DATE, 3).try_cast("int")
    n, days, months, both = rows.agg(F.count_if(a.isNotNull()), F.count_if(a > 12), F.count_if(b > 12), F.count_if((a <= 12) & (b <= 12))).first()
    if not n:
        return "iso"
    if days and months:
        raise SchemaError("some dates are day first and some month first")
    if day_first is not None:
        if day_first and months:
            raise SchemaError("dates were stated to be day first, and some can't be")
        return "day" if day_first else "month"
    if both:
        raise SchemaError(f"{both} dates read either way; state their order")
    return "day" if days else "month"


def parse_stamps(stamp: Column, order: str) -> Column:
    """Aware or naive stamps of one date order; null where none fits."""
    short = {"day": "d/M/", "month": "M/d/", "iso": ""}[order]
    clean = F.regexp_replace(F.trim(stamp), r"^(\d{1,2})[.-](\d{1,2})[.-]", "$1/$2/")
    tries = [F.try_to_timestamp(F.trim(stamp))]
    if short:
        tries = [F.try_to_timestamp(clean, F.lit(f"{short}{y}{t}")) for y in ("yyyy", "yy") for t in (" H:m:s", " H:m", "")] + tries
    return F.coalesce(*tries)
