"""Frames in time: as-of seek, debounce, late pings, pacing, numbering, log rings.

A file's rows are worked on by stretches of time, so a file that holds a third of all rows is many
tasks. What a stretch needs from the others of its file (their last frame, their sums) is one row
for each stretch; only a window over those rows follows a file from end to end. ``stretch_us``
sets how long a stretch is: a stretch of the busiest file has to fit one task.

Rows with a null file or time belong to no sequence and are left out. Rows of equal time are taken
by their second order column (frame_id or seq); those equal in both, in any order. Repeated rows
count as often as they occur; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: A day, the default stretch.
DAY = 86_400_000_000


def stretched(rows: DataFrame, keys: list[str], time: str, stretch_us: int = DAY) -> DataFrame:
    """``rows`` with _stretch, the number of each row's stretch of time; rows with a null key or time go."""
    known = rows.dropna(subset=[*keys, time])
    return known.withColumn("_stretch", F.expr(f"`{time}` div {int(stretch_us)}"))


def carried(rows: DataFrame, keys: list[str], inside: dict[str, Column], across: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """``rows`` with columns that ``across`` computes over the stretches of each key, in order, from the aggregates ``inside`` of each."""
    each = rows.groupBy(*keys, "_stretch").agg(*(c.alias(n) for n, c in inside.items()))
    order = Window.partitionBy(*keys).orderBy("_stretch")
    each = each.select(*keys, "_stretch", *(c.alias(n) for n, c in across(order).items()))
    return rows.join(each, [*keys, "_stretch"])


def _before(order: WindowSpec) -> WindowSpec:
    return order.rowsBetween(Window.unboundedPreceding, -1)


def _until(keys: list[str], *order: str) -> WindowSpec:
    """Rows of a stretch up to the current one."""
    return Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def latest_before(probes: DataFrame, frames: DataFrame, stretch_us: int = DAY) -> DataFrame:
    """Each probe (file_id, at_us) with the latest frame (frame_id, pts_us) at or before it, or nulls.

    One shuffle by file and stretch: probes and frames in one order, frames before probes of the
    same time, and the last frame seen, in this stretch or at the end of those before.
    """
    both = frames.select("file_id", F.col("pts_us").alias("t"), F.lit(0).alias("kind"), F.struct("pts_us", "frame_id").alias("f"))
    asked = probes.select("file_id", F.col("at_us").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(both.schema["f"].dataType).alias("f"))
    rows = stretched(both.unionByName(asked), ["file_id"], "t", stretch_us).withColumn("frame_id", F.col("f.frame_id"))
    rows = carried(rows, ["file_id"], {"tail": F.max("f")}, lambda order: {"earlier": F.last("tail", ignorenulls=True).over(_before(order))})
    found = rows.withColumn("last", F.coalesce(F.last("f", ignorenulls=True).over(_until(["file_id"], "t", "kind", "frame_id")), "earlier")).where("kind = 1")
    return found.select("file_id", F.col("t").alias("at_us"), "last.frame_id", "last.pts_us")


def debounced(events: DataFrame, wait_us: int, stretch_us: int = DAY) -> DataFrame:
    """Events (file_id, frame_id, pts_us, ...) that no other event of their file follows within the wait."""
    rows = stretched(events, ["file_id"], "pts_us", stretch_us)
    rows = carried(rows, ["file_id"], {"_first": F.min("pts_us")}, lambda order: {"_next": F.lead("_first").over(order)})
    order = Window.partitionBy("file_id", "_stretch").orderBy("pts_us", "frame_id")
    wait = F.coalesce(F.lead("pts_us").over(order), "_next") - F.col("pts_us")
    return rows.withColumn("_wait", wait).where(F.col("_wait").isNull() | (F.col("_wait") >= wait_us)).select(*events.columns)


def hang_episodes(pings: DataFrame, limit_us: int, stretch_us: int = DAY) -> DataFrame:
    """file_id, started_us, longest_us and n of each run of pings (file_id, frame_id, pts_us, active) that come later than the limit after the one before.

    A ping whose ``active`` is null or false doesn't hang.
    """
    rows = stretched(pings.select("file_id", "frame_id", "pts_us", "active"), ["file_id"], "pts_us", stretch_us)
    rows = carried(rows, ["file_id"], {"_last": F.max("pts_us")}, lambda order: {"previous": F.lag("_last").over(order)})
    order = Window.partitionBy("file_id", "_stretch").orderBy("pts_us", "frame_id")
    rows = rows.withColumn("gap", F.col("pts_us") - F.coalesce(F.lag("pts_us").over(order), "previous"))
    rows = rows.withColumn("hang", F.coalesce((F.col("gap") > limit_us) & F.col("active"), F.lit(False)))
    rest = F.when(F.col("hang"), 0).otherwise(1)
    rows = carried(rows, ["file_id"], {"_rest": F.sum(rest)}, lambda order: {"earlier": F.coalesce(F.sum("_rest").over(_before(order)), F.lit(0))})
    rows = rows.withColumn("episode", F.col("earlier") + F.sum(rest).over(_until(["file_id"], "pts_us", "frame_id")))
    found = rows.where("hang").groupBy("file_id", "episode").agg(F.min(F.col("pts_us") - F.col("gap")).alias("started_us"), F.max("gap").alias("longest_us"), F.count("*").alias("n"))
    return found.select("file_id", "started_us", "longest_us", "n")


def paced(frames: DataFrame, now_ms: Column, started_ms: Column, stretch_us: int = DAY) -> DataFrame:
    """``frames`` (file_id, pts_us, ...) with target_ms, when each is due after its file's first frame, and late, whether that is past."""
    rows = stretched(frames, ["file_id"], "pts_us", stretch_us)
    rows = carried(rows, ["file_id"], {"_first": F.min("pts_us")}, lambda order: {"_start": F.first("_first").over(order)})
    target = (F.col("pts_us") - F.col("_start")) / 1000
    return rows.select(*frames.columns, target.alias("target_ms"), (started_ms + target < now_ms).alias("late"))


def numbered(frames: DataFrame, signature: Column, stretch_us: int = DAY) -> DataFrame:
    """file_id, frame_id, n and signatures: each frame's number in its file, from 1, and how many of the file's signatures differ.

    A null signature isn't counted.
    """
    rows = stretched(frames.select("file_id", "frame_id", "pts_us", signature.alias("_signature")), ["file_id"], "pts_us", stretch_us)
    rows = carried(rows, ["file_id"], {"_rows": F.count("*")}, lambda order: {"_earlier": F.coalesce(F.sum("_rows").over(_before(order)), F.lit(0))})
    n = F.col("_earlier") + F.row_number().over(Window.partitionBy("file_id", "_stretch").orderBy("pts_us", "frame_id"))
    # one row for each stretch carries the file's count, so that a long file joins in many tasks
    distinct = rows.groupBy("file_id").agg(F.count_distinct("_signature").alias("signatures"))
    counts = rows.select("file_id", "_stretch").distinct().join(distinct, "file_id")
    return rows.withColumn("n", n.cast("bigint")).join(counts, ["file_id", "_stretch"]).select("file_id", "frame_id", "n", "signatures")


def latest_entries(log: DataFrame, k: int = 1000) -> DataFrame:
    """``log`` (file_id, frame_id, pts_us, ...) cut to the k latest entries of each file, with their number n, 1 for the latest.

    Up to k = 1000 each task keeps no more than k of a file before the shuffle.
    """
    latest = Window.partitionBy("file_id").orderBy(F.desc("pts_us"), F.desc("frame_id"))
    return log.withColumn("n", F.row_number().over(latest)).where(F.col("n") <= k)


def running_average(log: DataFrame, keys: list[str], amount: Column, stretch_us: int = DAY) -> DataFrame:
    """``log`` (keys, pts_us, seq, ...) with the average of ``amount``, whole numbers, over the rows of its keys so far."""
    rows = stretched(log.withColumn("_amount", amount), keys, "pts_us", stretch_us)
    earlier = lambda order: {n: F.coalesce(F.sum(n).over(_before(order)), F.lit(0)) for n in ("_total", "_rows")}
    rows = carried(rows, keys, {"_total": F.sum("_amount"), "_rows": F.count("*")}, earlier)
    order = _until(keys, "pts_us", "seq")
    total = F.col("_total") + F.coalesce(F.sum("_amount").over(order), F.lit(0))
    return rows.withColumn("average", total / (F.col("_rows") + F.count("*").over(order))).select(*log.columns, "average")
