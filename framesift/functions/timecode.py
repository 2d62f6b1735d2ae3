"""Seconds and sizes as text, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framesift.functions.geometry import half_up


def _two(n: Column) -> Column:
    """At least two digits; longer numbers stay whole."""
    return F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))


def hms(seconds: Column) -> Column:
    """hh:mm:ss of rounded seconds; null unless positive."""
    s = half_up(seconds).cast("bigint")
    text = F.concat_ws(":", _two(F.floor(s / 3600)), _two(F.floor(s % 3600 / 60)), _two(s % 60))
    return F.when(seconds > 0, text)


def minutes(seconds: Column) -> Column:
    """m:ss of seconds, rounded down."""
    m = F.floor(seconds / 60)
    return F.concat_ws(":", m.cast("string"), _two(F.floor(seconds - m * 60)))


def parse(text: Column) -> Column:
    """Seconds of ``h:m:s``, ``m:s`` or a text that starts with a number; null for others and for negative numbers."""
    t = F.trim(text)
    part = lambda i: F.split_part(t, F.lit(":"), F.lit(i)).try_cast("double")
    plain = F.nullif(F.regexp_extract(t, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0), F.lit("")).try_cast("double")
    return (
        F.when(t.rlike(r"^\d+:\d+:\d+(\.\d*)?$"), part(1) * 3600 + part(2) * 60 + part(3))
        .when(t.rlike(r"^\d+:\d+(\.\d*)?$"), part(1) * 60 + part(2))
        .otherwise(F.when(plain >= 0, plain))
    )


def eta_text(ms: Column) -> Column:
    """Remaining time in words: under 5 seconds almost done, under a minute ~Ns, else ~Mm SSs."""
    s = half_up(ms / 1000).cast("bigint")
    longer = F.concat(F.lit("~"), F.floor(s / 60).cast("string"), F.lit("m "), _two(s % 60), F.lit("s"))
    return F.when(s < 5, "almost done").when(s < 60, F.concat(F.lit("~"), s.cast("string"), F.lit("s"))).otherwise(longer)


def size_parts(n: Column) -> tuple[Column, Column]:
    """Decimal unit (KB, MB, GB) of a number of bytes, and the amount in it."""
    unit = F.when(n < 1_000_000, "KB").when(n < 1_000_000_000, "MB").otherwise("GB")
    return unit, n / F.when(n < 1_000_000, 1e3).when(n < 1_000_000_000, 1e6).otherwise(1e9)


def clock(seconds: Column) -> Column:
    """m:ss.SSS of seconds, to the nearest thousandth; null for null."""
    m = F.floor(seconds / 60)
    return F.when(seconds.isNotNull(), F.concat_ws(":", m.cast("string"), F.format_string("%06.3f", seconds - m * 60)))


def log_time(at: Column) -> Column:
    """hh:mm:ss.SSS of a timestamp, in the session's zone."""
    return F.date_format(at, "HH:mm:ss.SSS")


def scrubbed(value: Column, most: Column, duration_s: Column) -> Column:
    """Seconds at a scrubber's place; null without a length of the scrubber."""
    return F.try_divide(value, most) * duration_s
