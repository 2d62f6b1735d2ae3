"""Running statistics, export state, progress and remaining time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framesift.operators import seek

#: Frames a second taken for estimates, share of finalization before any history, and settings that only concern the export (fixed values).
FPS, FINALIZATION = 30, 0.1
EXPORT_ONLY = ("keepMetadata", "keepAudio", "exportMode", "namingPattern")


def _hundredths(ms: Column) -> Column:
    # whole numbers add up the same in any order
    return F.round(ms * 100).cast("bigint")


def inference_totals(log: DataFrame, models: list[str]) -> DataFrame:
    """model, n, total_hundredths and average (null without runs) of the given models."""
    sums = log.groupBy("model").agg(F.count("*").alias("n"), F.sum(_hundredths(F.col("ms"))).alias("c"))
    names = log.sparkSession.createDataFrame([(x,) for x in models], "model string")
    zero = F.lit(0).cast("bigint")
    return names.join(sums, "model", "left").select("model", F.coalesce("n", zero).alias("n"), F.coalesce("c", zero).alias("total_hundredths"), F.try_divide(F.col("c").cast("double"), F.col("n").cast("double")).alias("average"))


def running_average(log: DataFrame, keys: list[str], stretch_us: int = seek.DAY) -> DataFrame:
    """``log`` with the average of hundredths of a millisecond after each run; a null time counts as a run of nothing."""
    return seek.running_average(log, keys, _hundredths(F.col("ms")), stretch_us)


def finalization_fraction(finalization: Column, encoding: Column) -> Column:
    """Share of finalization in all encoding so far; a fixed share without history."""
    zero = F.lit(0)
    return F.when(finalization > 0, finalization / (finalization + F.coalesce(encoding, zero))).otherwise(F.lit(FINALIZATION))


def file_estimate(duration_s: Column, average_ms: Column) -> Column:
    return duration_s * FPS * average_ms


def file_remaining(p: Column, elapsed_ms: Column, estimate_ms: Column) -> Column:
    """From what has passed once that tells enough, before that from the estimate if there is one."""
    return F.when(p > 0.01, elapsed_ms * (1 - p) / p).when(estimate_ms > 0, estimate_ms * (1 - p))


def batch_remaining(items: DataFrame, average_ms: Column) -> DataFrame:
    """``items`` (batch, pos, est, remaining) with remaining_all: the current one's rest and the whole estimates, or averages, of those after it."""
    later = Window.partitionBy("batch").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    current = F.coalesce(F.col("remaining"), F.when(F.col("est") > 0, F.col("est")))
    whole = F.when(F.col("est") > 0, F.floor("est").cast("double")).otherwise(average_ms)
    return items.withColumn("remaining_all", F.floor(current) + F.coalesce(F.sum(whole).over(later), F.lit(0.0)))


def still_exported(exported: Column, changed: Column) -> Column:
    """Whether an exported item stays so: any changed setting makes it unexported (null: nothing changed)."""
    return F.coalesce(exported, F.lit(False)) & (F.coalesce(F.size(changed), F.lit(0)) <= 0)


def exported_by_run(succeeded: Column, trim: list[tuple[Column, Column]]) -> Column:
    """Whether an item counts as exported after a run: it succeeded, and every (then, now) bound of its trim is unchanged; null equals null."""
    same = F.coalesce(succeeded, F.lit(False))
    for then, now in trim:
        same = same & then.eqNullSafe(now)
    return same


def needs_redraw(changed: Column) -> Column:
    """Whether any changed setting concerns more than the export."""
    return ~F.forall(changed, lambda k: k.isin(*EXPORT_ONLY))


def remapped(done: Column, waited_ms: Column, expected_ms: Column, fraction: Column) -> Column:
    """Overall progress: encoding up to 1 - fraction, then the clock up to 99 % of the rest."""
    clock = F.least(F.try_divide(waited_ms, expected_ms), F.lit(0.99))
    return F.when(done >= 1, (1 - fraction) + clock * fraction).otherwise(done * (1 - fraction))


def pending(items: DataFrame, force: bool = False) -> DataFrame:
    """Items that aren't exported yet; all of them if forced."""
    return items if force else items.where(~F.col("exported"))


def active_after_removal(n: Column, active: Column, removed: Column) -> Column:
    """Index of the active one of n items after one is removed: -1 if none is left."""
    return F.when(n == 1, -1).when(removed < active, active - 1).when(removed == active, F.least(removed, n - 2)).otherwise(active)
