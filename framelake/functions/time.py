"""Rational media time: a value in units of 1 / timescale seconds, compared exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def media_time(value: Column, timescale: Column) -> Column:
    """struct(value, timescale); null where the timescale is not positive."""
    return F.when(timescale > 0, F.struct(value.cast("long").alias("value"), timescale.cast("long").alias("timescale")))


def _cross(a: Column, b: Column) -> Column:
    return a["value"].cast("decimal(19,0)") * b["timescale"].cast("decimal(10,0)")


def compare_times(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by exact rational value; null where either is null."""
    return F.sign(_cross(a, b) - _cross(b, a)).cast("int")


def seconds(value: Column, timescale: Column) -> Column:
    """For display only; never for ordering."""
    return value.cast("double") / timescale.cast("double")


def rescale(value: Column, from_scale: Column, to_scale: Column) -> Column:
    """Value in another timescale, truncated toward zero."""
    return F.call_function("div", value.cast("decimal(19,0)") * to_scale.cast("decimal(10,0)"), from_scale.cast("decimal(10,0)")).cast("long")


def parse_seconds(text: Column) -> Column:
    """Decimal seconds as an exact media time: whole digits, then at most nine after the point. ``1.`` fits, ``.5`` does not.

    Null where the value in its own timescale is over 64 bits.
    """
    pattern = r"^(\d+)(?:\.(\d{0,9}))?\z"
    fraction = F.regexp_extract(text, pattern, 2)
    scale = F.rpad(F.lit("1"), F.length(fraction) + 1, F.lit("0")).cast("long")
    digits = F.regexp_replace(F.concat(F.regexp_extract(text, pattern, 1), fraction), r"^0+(?=\d)", "")
    value = F.when(F.length(digits) <= 19, digits.try_cast("decimal(19,0)"))
    return F.when(text.rlike(pattern) & (value <= (1 << 63) - 1), media_time(value, scale))
