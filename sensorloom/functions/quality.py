"""Severity of raw quality codes, as column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vendor strings, digital states of historians, and OPC UA status codes.
STRING_SEVERITY = {
    "GOOD": "GOOD",
    "UNCERTAIN": "UNCERTAIN",
    "SUBSTITUTED": "UNCERTAIN",
    "SCAN OFF": "UNCERTAIN",
    "BAD": "BAD",
    "OVER RANGE": "BAD",
    "UNDER RANGE": "BAD",
    "COMM FAILURE": "BAD",
}
DIGITAL_SEVERITY = {248: "BAD", 249: "BAD", 250: "UNCERTAIN", 251: "UNCERTAIN", 257: "BAD"}
RANGE_STATES = (257,)
GOOD_STATUS = (
    0x00000000, 0x002D0000, 0x002E0000, 0x002F0000, 0x00300000, 0x00960000, 0x00A20000,
    0x00A30000, 0x00A50000, 0x00A60000, 0x00BA0000, 0x00D90000, 0x00DC0000, 0x00E00000,
)
RANK = {"BAD": 0, "UNCERTAIN": 1, "GOOD": 2}
FLOAT32_MAX = 3.4028234663852886e38


def numeric_code(quality: Column) -> Column:
    """Integer view of a code: digits, or an integral decimal; anything else is null."""
    return F.regexp_extract(F.trim(quality), r"^([+-]?[0-9]{1,18})(\.0*)?$", 1).try_cast("bigint")


def _table(entries: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in entries.items() for x in kv))


def _declared(quality: Column, codes: Column | None) -> Column:
    if codes is None:
        return F.lit(None).cast("string")
    folded = F.transform_keys(codes, lambda k, _: F.upper(F.trim(k)))
    return F.coalesce(F.try_element_at(codes, quality), F.try_element_at(folded, F.upper(F.trim(quality))))


def severity(quality: Column, codes: Column | None = None, code: Column | None = None) -> Column:
    """Declared code, then digital state, then status bits, then vendor string, else UNCERTAIN.

    ``code`` is the numeric view where a column already holds it.
    """
    code = numeric_code(quality) if code is None else code
    info = code.bitwiseAND(F.lit(0xFFFF))
    good = (code - info).isin(list(GOOD_STATUS)) & ((info == 0) | (info.bitwiseAND(F.lit(0x0C00)) != 0))
    bits = F.when((code < 0) | (code >= 1 << 31), "BAD").when(good, "GOOD").when(code.isNotNull(), "UNCERTAIN")
    digital = F.try_element_at(_table(DIGITAL_SEVERITY), code.try_cast("int"))
    return F.coalesce(_declared(quality, codes), digital, bits, F.try_element_at(_table(STRING_SEVERITY), F.upper(F.trim(quality))), F.lit("UNCERTAIN"))


def unmapped(quality: Column, codes: Column | None = None, code: Column | None = None) -> Column:
    """Whether no rule but the last said anything about the code."""
    code = numeric_code(quality) if code is None else code
    known = F.upper(F.trim(quality)).isin(list(STRING_SEVERITY)) | code.isin(list(DIGITAL_SEVERITY)) | (F.shiftright(code, 30) == 1)
    return (severity(quality, codes, code) == "UNCERTAIN") & _declared(quality, codes).isNull() & ~F.coalesce(known, F.lit(False))


# What the digital states are called.
DIGITAL_LABEL = {248: "Bad", 249: "Comms Outage", 250: "Scan Off", 251: "Substituted", 257: "Over Range"}


def digital_state_label(code: Column) -> Column:
    """The name of a digital state; null for other codes."""
    return F.try_element_at(_table(DIGITAL_LABEL), code.try_cast("int"))


def meets(severity_name: str, least: str) -> bool:
    return RANK[severity_name] >= RANK[least]


def rank(severity_name: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, sorted(RANK, key=RANK.get))), severity_name) - 1).cast("tinyint")


def clipped(value: Column, code: Column, zero: Column, span: Column) -> Column:
    """At or beyond an end of the engineering range, or in a range state; false where the range is unknown."""
    edge = F.lit(1e-9) * span
    return F.coalesce((value >= zero + span - edge) | (value <= zero + edge), F.lit(False)) | F.coalesce(code.isin(list(RANGE_STATES)), F.lit(False))


#: Distinct codes that are met by broadcast, a few MB; any others are worked out row by row.
MAX_CODES = 10_000
TAG = ["source_id", "point_id"]


def _facts(quality: Column, codes: Column | None) -> Column:
    """What the rules say about one code: severity, unmapped, q_num, is_digital_state, sev_rank."""

    def told(code: Column) -> Column:
        name = severity(quality, codes, code)
        digital = F.coalesce(code.isin(list(DIGITAL_SEVERITY)), F.lit(False))
        return F.struct(name.alias("severity"), unmapped(quality, codes, code).alias("unmapped"), code.alias("q_num"), digital.alias("is_digital_state"), rank(name).alias("sev_rank"))

    return F.get(F.transform(F.array(numeric_code(quality)), told), F.lit(0))  # the number is read once, however often it is asked for


def per_distinct_code(samples: DataFrame, codes: str | None = None, out: str = "_facts") -> DataFrame:
    """Adds the struct ``out`` of the facts about a row's code, worked out once per distinct code.

    The distinct codes (by tag where tags declare ``codes``) are found with a map-side combined
    aggregate and met by broadcast, at most ``MAX_CODES`` of them. The rules are expressions, so a
    code beyond that number gets the same answer from its own row.
    """
    if samples.isStreaming:  # a stream can't wait for its own distinct codes
        return samples.withColumn(out, _facts(F.col("quality"), F.col(codes) if codes else None))
    keys = [*TAG, "quality"] if codes else ["quality"]
    found = samples.groupBy(*keys).agg(F.first(codes).alias("_codes")) if codes else samples.select("quality").distinct()
    found = found.limit(MAX_CODES).select(*(F.col(k).alias(f"_{k}") for k in keys), _facts(F.col("quality"), F.col("_codes") if codes else None).alias("_known"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    facts = F.when(F.col("_known").isNotNull(), F.col("_known")).otherwise(_facts(F.col("quality"), F.col(codes) if codes else None))
    return samples.join(F.broadcast(found), same, "left").select(*samples.columns, facts.alias(out))


def annotate(samples: DataFrame, codes: str | None = None, least: str = "GOOD") -> DataFrame:
    """Adds severity, sev_rank, q_num, is_digital_state, unmapped and valid.

    A value on a digital state is nulled; NaN is no value. MODE rows (with ``state``) are valid by their state.
    """
    out = per_distinct_code(samples, codes)
    value = F.when(~F.col("_facts.is_digital_state") & ~F.isnan("value"), F.col("value"))
    has = F.coalesce(F.col("state").isNotNull(), F.lit(False)) | value.isNotNull() if "state" in samples.columns else value.isNotNull()
    good = (F.col("_facts.severity") == "GOOD") if least == "GOOD" else (F.col("_facts.sev_rank") >= RANK[least])
    rest = [F.col(c) for c in samples.columns if c != "value"]
    facts = [F.col(f"_facts.{c}").alias(c) for c in ("q_num", "severity", "unmapped", "is_digital_state", "sev_rank")]
    return out.select(*rest, value.alias("value"), *facts, (good & has).alias("valid"))
