"""Structured Streaming jobs over the event table, run on what is there (availableNow) and read back.

State lives in the state store; output and checkpoints go to a fresh folder under the session's
shared checkpoint folder, so driver and executors see the same files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.sources.shared import shared_folder
from framesift.streaming import stateful


def _folder(spark: SparkSession) -> str:
    return shared_folder(spark, "stream")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream: file_id, frame_id, at (timestamp), pts_us, event_type, value."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a file stream reads folders; a glob also matches a single file
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path + "*")
    at = F.col("ts").cast("timestamp")
    return rows.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("frame_id"), at.alias("at"), F.unix_micros(at).alias("pts_us"), "event_type", "value")


def upsert_sink(frame: DataFrame, keys: list[str], spark: SparkSession) -> DataFrame:
    """Run a stream in update mode; of each key's updates the one of the last batch counts."""
    folder = _folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is tried again writes the same folder again
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    frame.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    others = [c for c in frame.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_row"))
    return last.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("event_type").isin("view", "click"), "detect_n").otherwise("detect_x").alias("model")
    sums = events(spark, sf_dir).groupBy(model).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("total_hundredths"))
    return upsert_sink(sums, ["model"], spark)


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = events(spark, sf_dir).groupBy("file_id", F.expr("pts_us div 21600000000").alias("slot")).agg(F.max("frame_id").alias("frame_id"))
    return upsert_sink(slots, ["file_id", "slot"], spark)


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode returns every window. The run ends with its input, so no watermark drops events of files that come out of order."""
    rows = events(spark, sf_dir)
    counts = rows.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return upsert_sink(counts.select(F.unix_micros("window.start").alias("window_us"), "event_type", "n"), ["window_us", "event_type"], spark)


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom state: each file's highest generation and its number of results."""
    import pandas as pd

    rows = events(spark, sf_dir).select("file_id", (F.col("frame_id") % 97).alias("generation"))

    def keep(key: tuple, parts, state):
        top, n = state.get if state.exists else (-1, 0)
        for part in parts:
            top, n = max(top, int(part["generation"].max())), n + len(part)
        state.update((top, n))
        yield pd.DataFrame({"file_id": [key[0]], "generation": [top], "n": [n]})

    schema = "file_id bigint, generation bigint, n bigint"
    found = rows.groupBy("file_id").applyInPandasWithState(keep, schema, "top bigint, n bigint", "update", "NoTimeout")
    return upsert_sink(found, ["file_id"], spark)


def playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of frames joined to the static table of cached detections, each frame written once."""
    cached = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 3 <> 0").select(F.col("event_id").alias("frame_id"), F.expr("event_id % 7").alias("n"))
    found = events(spark, sf_dir).select("frame_id").join(cached, "frame_id", "left")
    folder = _folder(spark)
    rows = found.select("frame_id", F.coalesce("n", F.lit(-1)).cast("bigint").alias("n"), F.col("n").isNotNull().alias("drawn"))
    sink = rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


#: A watermark's delay over which files of the event table may come in any order.
ANY_ORDER = "400 days"
_STAGED = "file_id bigint, frame_id bigint, pts_us bigint, event_type string, value double, active boolean"


def state_partitions(spark: SparkSession) -> int:
    """Partitions of a stream's state: the session's, but no more than tasks that run at once. Each has a store that every micro-batch opens and commits, whatever it holds."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(8, spark.sparkContext.defaultParallelism))


def in_two_runs(spark: SparkSession, sf_dir: str, job: Callable[[DataFrame], DataFrame], files: int = 4, mode: str = "append") -> DataFrame:
    """What a stream over the event table has written when it has seen all of it.

    Events lie in several files, each a micro-batch. The query ends with them; then rows of a far
    later time come in (with negative frame_id, one for each file and a last one), and the query
    goes on from its checkpoint, so that every timer and every outer join is settled.
    """
    session, folder = stateful.with_rocksdb(spark), _folder(spark)
    session.conf.set("spark.sql.shuffle.partitions", str(state_partitions(spark)))
    given = session.read.parquet(f"{sf_dir}/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = given.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("frame_id"), at.alias("pts_us"), "event_type", "value", (F.col("event_type") != "signup").alias("active"))
    rows.repartition(files).write.parquet(f"{folder}/in")

    def run() -> None:
        read = session.readStream.schema(_STAGED).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

        job(read).writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()

    run()
    late = lambda files, days: files.select("file_id", F.lit(-1).cast("bigint").alias("frame_id"), (F.lit(days) * F.lit(86_400_000_000)).cast("bigint").alias("pts_us"), F.lit("signup").alias("event_type"), F.lit(0.0).alias("value"), F.lit(False).alias("active"))
    last = late(rows.select("file_id").distinct(), 100_000).unionByName(late(session.range(1).select((-F.col("id") - 1).alias("file_id")), 102_000))
    last.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    run()
    # the caller's own session reads what has been written
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def debounced(spark: SparkSession, sf_dir: str, wait_us: int) -> DataFrame:
    found = in_two_runs(spark, sf_dir, lambda rows: stateful.debounced(rows, wait_us, ANY_ORDER))
    return found.where("frame_id >= 0 AND NOT late").select("file_id", "frame_id")


def hang_episodes(spark: SparkSession, sf_dir: str, limit_us: int) -> DataFrame:
    found = in_two_runs(spark, sf_dir, lambda rows: stateful.hang_episodes(rows, limit_us, ANY_ORDER))
    return found.where("NOT late").select("file_id", "started_us", "longest_us", "n")


def running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each model: n grows with each micro-batch that holds the model."""
    model = F.when(F.col("event_type").isin("view", "click"), "detect_n").otherwise("detect_x").alias("model")
    amounts = lambda rows: rows.where("frame_id >= 0").select(model, F.round(F.col("value") * 100).cast("bigint").alias("amount"))
    found = in_two_runs(spark, sf_dir, lambda rows: stateful.running_stats(amounts(rows)), mode="update")
    return found.groupBy("model").agg(F.max_by(F.struct("n", "total_hundredths"), "n").alias("r")).select("model", "r.n", "r.total_hundredths")


def misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame once, with what its detections' stream holds for it."""

    def job(rows: DataFrame) -> DataFrame:
        timed = rows.withColumn("at", F.timestamp_micros("pts_us"))
        cached = timed.withColumn("n", F.expr("if(frame_id % 3 <> 0 AND frame_id >= 0, frame_id % 7, null)"))
        return stateful.drawn_or_missed(timed, cached, ANY_ORDER)

    found = in_two_runs(spark, sf_dir, job).where("frame_id >= 0")
    return found.select("frame_id", F.coalesce("n", F.lit(-1)).cast("bigint").alias("n"), F.col("n").isNotNull().alias("drawn"))
