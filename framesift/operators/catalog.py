"""The media catalog: admission of files, first of equal ones, trims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accepted(files: DataFrame) -> DataFrame:
    """Pictures and videos, by MIME type."""
    return files.where(F.col("mime").startswith("image/") | F.col("mime").startswith("video/"))


def first_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` of each key, by a pre-aggregated minimum."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def admit(files: DataFrame, known: DataFrame) -> DataFrame:
    """Accepted files whose name and size are new; the first of them is active."""
    old = known.select("name", "size").distinct()
    new = first_by(accepted(files).join(old, ["name", "size"], "left_anti"), ["name", "size"], "pos")
    first = new.agg(F.min("pos").alias("pos")).withColumn("active", F.lit(True))
    return new.join(F.broadcast(first), "pos", "left").withColumn("active", F.coalesce("active", F.lit(False)))


def clamp_trims(files: DataFrame, saved: DataFrame) -> DataFrame:
    """Videos with their saved trims (pos, t0, t1) put into the duration and into order."""
    inside = lambda t: F.greatest(F.lit(0.0), F.least(F.col("duration_s"), t))
    rows = files.where("is_video").join(saved, "pos", "left")
    a, b = inside(F.coalesce("t0", F.lit(0.0))), inside(F.coalesce("t1", "duration_s"))
    rows = rows.withColumns({"trim_start": F.least(a, b), "trim_end": F.greatest(a, b)})
    trimmed = (F.col("trim_start") > 0) | (F.abs(F.col("trim_end") - F.col("duration_s")) > 0.001)
    return rows.withColumns({"single_frame": F.col("trim_start") == F.col("trim_end"), "is_trimmed": trimmed})
