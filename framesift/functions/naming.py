"""Output names from templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(name: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]+$", "")


def plain_number(x: Column) -> Column:
    """A number as text without a trailing ``.0``."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def values(*, stem: Column, index: Column, captured_at: Column, model: Column, style: Column, labels: Column, least: Column, expansion: Column, **more: Column) -> Column:
    """Map from a template's variables to text; further variables by keyword. Missing values are null."""
    part = lambda f: F.date_format(captured_at, f)
    found = {
        "input": stem, "index": index.cast("string"), "year": part("yyyy"), "month": part("MM"), "day": part("dd"), "hour": part("HH"), "minute": part("mm"),
        "model": F.when(model == "detect_x", "large").otherwise("small"), "redaction_style": style, "detect": F.array_join(F.array_sort(labels), "-"),
        "min_confidence": plain_number(least), "area_expansion": plain_number(expansion),
    } | more
    return F.create_map(*[x for k, v in found.items() for x in (F.lit(k), v)])


def fill(pattern: Column, values: Column) -> Column:
    """Replace each ``{word}`` by its value, unknown and missing ones by nothing, in one pass: values aren't scanned again."""
    gaps = F.split(pattern, r"\{\w+\}", -1)
    keys = F.regexp_extract_all(pattern, F.lit(r"\{(\w+)\}"), F.lit(1))
    filled = F.transform(keys, lambda k: F.coalesce(F.try_element_at(values, k), F.lit("")))
    pairs = F.zip_with(gaps, filled, lambda g, v: F.concat(g, F.coalesce(v, F.lit(""))))
    return F.array_join(pairs, "")
