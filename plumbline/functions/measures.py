"""Column functions on numbers, units, angles and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a unit.
METRES = {"m": 1.0, "ft": 0.3048, "us_ft": 1200 / 3937, "meters": 1.0, "international_feet": 0.3048, "us_survey_feet": 1200 / 3937}


def factor_of(unit: str) -> float:
    """Metres in a unit that is named in full or short; others raise."""
    if unit not in METRES:
        raise ValueError(f"unknown unit {unit!r}")
    return METRES[unit]


def finite(text: Column) -> Column:
    """The number that a text holds, or null when it isn't a finite number."""
    value = F.expr("1.0D") * text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def unit_factor(unit: Column) -> Column:
    """Metres in one unit, by its full or short name; null for others."""
    name = F.lower(F.trim(unit))
    return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in METRES.items()])


def duration_seconds(text: Column, hint: str = "seconds") -> Column:
    """Seconds of ``5 min``, ``HH:MM:SS``, ``MM:SS`` or a bare number in the unit of ``hint``."""
    t = F.lower(F.trim(text))
    part = lambda pattern, k: F.regexp_extract(t, pattern, k).try_cast("double")
    hms, ms = r"^(\d+):(\d{1,2}):(\d{1,2}(?:\.\d+)?)$", r"^(\d+):(\d{1,2}(?:\.\d+)?)$"
    unit = r"^([0-9.]+)\s*(h|hr|hrs|hour|hours|m|min|mins|minute|minutes|s|sec|secs|second|seconds)$"
    scale = F.when(F.regexp_extract(t, unit, 2).startswith("h"), 3600.0).when(F.regexp_extract(t, unit, 2).startswith("m"), 60.0).otherwise(1.0)
    bare = t.try_cast("double") * {"seconds": 1.0, "minutes": 60.0, "hours": 3600.0}[hint]
    return (
        F.when(t.rlike(hms), part(hms, 1) * 3600 + part(hms, 2) * 60 + part(hms, 3))
        .when(t.rlike(ms), part(ms, 1) * 60 + part(ms, 2))
        .when(t.rlike(unit), part(unit, 1) * scale)
        .when(t.rlike(r"^[0-9.]+$"), bare)
    )


#: Date and time texts that field notes use, tried in this order; then times of day.
MOMENTS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "M/d/yyyy HH:mm:ss", "M/d/yyyy HH:mm", "M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a",
    "yyyy/M/d HH:mm:ss", "yyyy/M/d HH:mm", "dd-MMM-yyyy HH:mm:ss", "yyyy-MM-dd",
)
TIMES = ("H:mm:ss", "H:mm", "h:mm:ss a", "h:mm a")
_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def observed_time(text: Column) -> Column:
    """A timestamp from ISO or common field-book date and time texts (an offset is taken off); null for others."""
    t = F.trim(text)
    offset = F.regexp_extract(t, _OFFSET, 1)
    zoned = (offset != "") & t.contains("T")
    minutes = F.when(offset.isin("", "Z"), 0).otherwise(F.concat(F.substring(offset, 1, 1), F.lit("1")).try_cast("int") * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, -2, 2).try_cast("int")))
    plain = F.when(zoned, F.regexp_replace(t, _OFFSET, "")).otherwise(t)
    found = F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in MOMENTS])
    return F.when(zoned, F.timestamp_seconds(F.unix_timestamp(found) - minutes * 60)).otherwise(found)


def time_of_day(text: Column) -> Column:
    """Seconds after midnight of a text that is a time alone; null for others."""
    t = F.trim(text)
    found = F.coalesce(*[F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), F.upper(t)), F.lit("yyyy-MM-dd " + f)) for f in TIMES])
    return F.when(t.rlike("^[0-9]{1,2}:"), F.hour(found) * 3600 + F.minute(found) * 60 + F.second(found)).cast("double")


def angle_difference(calculated: Column, observed: Column) -> Column:
    """Difference of two angles in degrees, from -180 up to 180."""
    return F.pmod(calculated - observed + 180.0, F.lit(360.0)) - 180.0


def normal_degrees(angle: Column) -> Column:
    return F.pmod(angle, F.lit(360.0))


def huber_weight(residual: Column, k: float) -> Column:
    """1 up to ``k``, then ``k / |residual|``."""
    return F.when(F.abs(residual) <= k, F.lit(1.0)).otherwise(k / F.abs(residual))


def three_wire(upper: Column, middle: Column, lower: Column) -> tuple[Column, Column, Column]:
    """Mean of the wires that are there, middle minus the half-sum of the others, and the intercept."""
    every = upper.isNotNull() & middle.isNotNull() & lower.isNotNull()
    mean = F.when(every, (upper + middle + lower) / 3).when(middle.isNotNull(), middle).when(upper.isNotNull() & lower.isNotNull(), (upper + lower) / 2)
    return mean, middle - (upper + lower) / 2, upper - lower


def near_increment(value: Column, increments: tuple[float, ...]) -> Column:
    """Struct of the distance to the nearest increment and that increment; ties go to the smaller one."""
    return F.array_min(F.array(*[F.struct(F.abs(F.abs(value) - i).alias("distance"), F.lit(i).alias("increment")) for i in increments]))
