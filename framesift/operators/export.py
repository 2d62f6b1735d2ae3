"""Export of redacted media: one status for each item, failures kept apart, results as a table of named files."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.sources import files


def run_batch(items: DataFrame, keys: list[str], order: str, result: Column, failure: Column, aborted: Column) -> DataFrame:
    """``items`` with status, error, output and done: a failed item doesn't stop the others, an aborted one stops its batch.

    Items of a batch (``keys``) run in ``order``: from the first on whose work is ``aborted`` (null:
    no) all are cancelled. ``failure`` is null where the item's work succeeded. Cancelled items
    have no output; ``done`` counts failures as completed, as progress does. The first abort of
    each batch is a pre-aggregated minimum; batches with a null key run like others.
    """
    # the flags may be any expressions, so they are columns before the join
    rows = items.withColumns({"_aborted": F.coalesce(aborted, F.lit(False)), "_failure": failure, "_result": result})
    first = rows.where("_aborted").groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(order).alias("_first"))
    met = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    cancelled = F.coalesce(F.col(order) >= F.col("_first"), F.lit(False))
    rows = rows.join(first, met, "left").withColumn("_cancelled", cancelled)
    status = F.when(F.col("_cancelled"), "cancelled").when(F.col("_failure").isNotNull(), "error").otherwise("ok")
    rows = rows.withColumns({"status": status, "error": F.when(~F.col("_cancelled"), F.col("_failure"))})
    rows = rows.withColumns({"output": F.when(F.col("status") == "ok", F.col("_result")), "done": F.col("status") != "cancelled"})
    return rows.select(*items.columns, "status", "error", "output", "done")


def summary(batch: DataFrame, keys: list[str]) -> DataFrame:
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    return batch.groupBy(*keys).agg(count("ok").alias("ok"), count("error").alias("errors"), count("cancelled").alias("cancelled"), F.count(F.when(F.col("done"), 1)).alias("completed"))


def export_until(items: DataFrame, order: str, render: Callable[[DataFrame], DataFrame], path: str, cancelled: Callable[[], bool], steps: int = 20, poll: float = 0.2) -> DataFrame:
    """Export ``items`` as named files in at most ``steps`` jobs by ``order``, until ``cancelled()``; ``items`` with status ok or cancelled.

    ``render`` makes name, content and exported_at of a step's items. Between steps, and every ``poll``
    seconds while one runs, the flag is asked; then the running job is cancelled by its tag and no
    later step starts. Files of finished steps stay, a step that was stopped leaves no file. Any other
    failure is raised. Rows with a null order go with the first step. Steps are cut by the approximate
    quantiles of ``order``, so equal values are in one.
    """
    spark = items.sparkSession
    context, tag = spark.sparkContext, f"export-{uuid.uuid4().hex}"
    files.recover(spark, path)  # what earlier writes left isn't this one's
    found = items.agg(F.percentile_approx(order, [k / steps for k in range(1, steps + 1)], 10000).alias("cuts")).first()["cuts"]
    cuts = sorted(set(found or []))
    # the last cut may lie below the greatest value: the step after it is open
    step = F.coalesce(sum((F.when(F.col(order) > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0)), F.lit(0))
    done, ended, stopped = 0, threading.Event(), threading.Event()

    def watch() -> None:
        while not ended.wait(poll):
            if stopped.is_set() or cancelled():
                stopped.set()
                # again and again: the step's next job may not have started
                context.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        for k in range(max(len(cuts), 1)):
            if stopped.is_set() or cancelled():
                break
            try:
                files.write_named(render(items.where(step == k)), path)
            except Exception:
                if not stopped.is_set():
                    raise
                break
            done = k + 1
    finally:
        ended.set()
        watcher.join()
        context.removeJobTag(tag)
    if files.recover(spark, path):
        done += 1  # the step that was stopped had already been committed
    return items.withColumn("status", F.when(step < done, "ok").otherwise("cancelled"))


def write_files(files: DataFrame, path: str, rows_per_file: int = 1000) -> None:
    """Write files (name, content) as Parquet with bounded part files; the latest of equal names wins by ``exported_at``, of equally late ones the larger content."""
    best = files.groupBy("name").agg(F.max_by("content", F.struct("exported_at", "content")).alias("content"), F.max("exported_at").alias("exported_at"))
    best.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def joined_log(ring: DataFrame, entry: Column) -> DataFrame:
    """file_id and text: the entries of each file's ring (n, 1 for the latest), oldest first, a line each. A ring bounds what a row gathers; null entries are left out."""
    lines = ring.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("n", entry.alias("line"))), asc=False).alias("lines"))
    return lines.select("file_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))
