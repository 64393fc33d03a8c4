"""Unit aliases, comparability and conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IncomparableUnits, UnresolvedUnit

# Fixed values: (alias, canonical name, dimension, factor to the base unit, offset, reference condition).
UNITS = [
    ("m3/h", "cubic meters per hour", "volume flow", 1 / 3600, 0.0, False),
    ("m³/h", "cubic meters per hour", "volume flow", 1 / 3600, 0.0, False),
    ("m3/s", "cubic meters per second", "volume flow", 1.0, 0.0, False),
    ("m³/s", "cubic meters per second", "volume flow", 1.0, 0.0, False),
    ("l/min", "liters per minute", "volume flow", 1 / 60000, 0.0, False),
    ("Nm3/h", "normal cubic meters per hour", "volume flow", 1 / 3600, 0.0, True),
    ("Sm3/h", "standard cubic meters per hour", "volume flow", 1 / 3600, 0.0, True),
    ("scfm", "standard cubic feet per minute", "volume flow", 0.028316846592 / 60, 0.0, True),
    ("kg/h", "kilograms per hour", "mass flow", 1 / 3600, 0.0, False),
    ("t/h", "metric tons per hour", "mass flow", 1000 / 3600, 0.0, False),
    ("lb/h", "pounds per hour", "mass flow", 0.45359237 / 3600, 0.0, False),
    ("bar", "bar", "pressure", 1e5, 0.0, False),
    ("mbar", "millibar", "pressure", 100.0, 0.0, False),
    ("psi", "pounds per square inch", "pressure", 6894.757293168361, 0.0, False),
    ("Pa", "pascals", "pressure", 1.0, 0.0, False),
    ("kPa", "kilopascals", "pressure", 1e3, 0.0, False),
    ("MPa", "megapascals", "pressure", 1e6, 0.0, False),
    ("degC", "degrees Celsius", "temperature", 1.0, 273.15, False),
    ("oC", "degrees Celsius", "temperature", 1.0, 273.15, False),
    ("°C", "degrees Celsius", "temperature", 1.0, 273.15, False),
    ("degF", "degrees Fahrenheit", "temperature", 5 / 9, 459.67 * 5 / 9, False),
    ("K", "kelvin", "temperature", 1.0, 0.0, False),
    ("percent", "percent", "ratio", 0.01, 0.0, False),
    ("%", "percent", "ratio", 0.01, 0.0, False),
    ("m/s", "meters per second", "speed", 1.0, 0.0, False),
    ("rpm", "revolutions per minute", "rotation", 1 / 60, 0.0, False),
    ("mA", "milliamperes", "current", 1e-3, 0.0, False),
    ("V", "volts", "voltage", 1.0, 0.0, False),
]
SCHEMA = "alias string, canonical string, dimension string, factor double, offset double, reference_condition boolean"


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNITS, SCHEMA)


def _find(raw: str | None):
    exact = {u[0]: u for u in UNITS}
    folded = {u[0].casefold(): u for u in UNITS}
    return None if raw is None else exact.get(raw) or folded.get(raw.strip().casefold())


def resolve(tags: DataFrame, unit: str = "unit_raw") -> DataFrame:
    """Adds canonical, dimension and reference_condition: the exact alias, else the trimmed one in any case."""
    units = table(tags.sparkSession)
    exact = units.select(F.col("alias").alias("_a"), *(F.col(c).alias(f"_e_{c}") for c in ("canonical", "dimension", "reference_condition")))
    folded = units.groupBy(F.lower("alias").alias("_f")).agg(*(F.max(c).alias(f"_f_{c}") for c in ("canonical", "dimension", "reference_condition")))
    both = tags.join(F.broadcast(exact), F.col(unit) == F.col("_a"), "left").join(F.broadcast(folded), F.lower(F.trim(F.col(unit))) == F.col("_f"), "left")
    return both.select(*tags.columns, *(F.coalesce(f"_e_{c}", f"_f_{c}").alias(c) for c in ("canonical", "dimension", "reference_condition")))


def check_comparable(a: str, b: str) -> None:
    x, y = _find(a), _find(b)
    if x is None or y is None:
        raise UnresolvedUnit(f"unit {a if x is None else b!r} is not known")
    if x[2] != y[2] or x[5] != y[5]:
        raise IncomparableUnits(f"{a!r} and {b!r} differ in dimension or reference condition")


def convert(value: float, a: str, b: str) -> float:
    check_comparable(a, b)
    x, y = _find(a), _find(b)
    return (value * x[3] + x[4] - y[4]) / y[3]
