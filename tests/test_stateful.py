"""Stream state that survives a stop, timers, late rows and the outer join of two streams, over several micro-batches."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from framesift.operators import seek
from framesift.streaming import jobs, stateful

SECOND = 1_000_000
SCHEMA = "file_id bigint, frame_id bigint, pts_us bigint, active boolean"


class Stream:
    """A folder that rows are put into, and a query over it that is run to its end again and again from one checkpoint."""

    def __init__(self, spark, folder, job, schema=SCHEMA, mode="append", once=False):
        self.session, self.folder, self.job, self.schema, self.mode = stateful.with_rocksdb(spark), f"file://{folder}", job, schema, mode
        # state that expires by the clock asks for batches without end, so such a query takes one at a time
        self.trigger = {"once": True} if once else {"availableNow": True}
        self.progress = []

    def put(self, rows):
        self.session.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self):
        read = self.session.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        out = f"{self.folder}/out"
        write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/n={n}")
        query = self.job(read).writeStream.outputMode(self.mode).option("checkpointLocation", f"{self.folder}/state").trigger(**self.trigger).foreachBatch(write).start()
        query.awaitTermination()
        self.progress += query.recentProgress
        return self.session.read.option("recursiveFileLookup", "true").parquet(out)


def pings(seed):
    rng = random.Random(seed)
    return [(file, file * 1000 + k, rng.randrange(3000) * SECOND, rng.random() < 0.8) for file in (1, 2, 3) for k in range(70)]


def by_time(rows, jitter, parts, seed=0):
    """Rows in micro-batches of nearly their order: none comes more than the jitter behind another."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r[2] + rng.randrange(jitter))
    size = -(-len(order) // parts)
    return [order[i : i + size] for i in range(0, len(order), size)]


CLOSE = [(k, -1, 10**6 * SECOND, False) for k in (1, 2, 3)]
LAST = [(-1, -1, 2 * 10**6 * SECOND, False)]


def test_debounce_by_timers_equals_the_batch_form(spark, tmp_path):
    rows, wait = pings(1), 15 * SECOND
    stream = Stream(spark, tmp_path, lambda r: stateful.debounced(r, wait, "120 seconds"))
    for part in by_time(rows, 100 * SECOND, 4):
        stream.put(part)
        found = stream.run()  # a stop and a restart after each
    stream.put(CLOSE + LAST)
    found = stream.run().where("frame_id >= 0")
    assert found.where("late").count() == 0
    wanted = seek.debounced(spark.createDataFrame(rows, SCHEMA), wait)
    assert sorted((r.file_id, r.frame_id) for r in found.collect()) == sorted((r.file_id, r.frame_id) for r in wanted.collect())


def test_late_rows_are_told_apart(spark, tmp_path):
    stream = Stream(spark, tmp_path, lambda r: stateful.debounced(r, 10 * SECOND, "20 seconds"))
    stream.put([(1, 1, 1 * SECOND, True), (1, 2, 500 * SECOND, True)])
    stream.run()
    stream.put([(1, 3, 5 * SECOND, True), (1, 4, 505 * SECOND, True), (2, 5, 2 * SECOND, True)])
    stream.put(CLOSE + LAST)
    found = {(r.file_id, r.frame_id, r.late) for r in stream.run().where("frame_id >= 0").collect()}
    # the row of second 5 comes after second 1 had been decided and doesn't change it
    assert found == {(1, 1, False), (1, 3, True), (2, 5, True), (1, 4, False)}


def test_hangs_by_timers_equal_the_batch_form(spark, tmp_path):
    rows, limit = pings(2), 60 * SECOND
    stream = Stream(spark, tmp_path, lambda r: stateful.hang_episodes(r, limit, "120 seconds"))
    for part in by_time(rows, 100 * SECOND, 3, seed=5):
        stream.put(part)
    stream.run()
    stream.put(CLOSE + LAST)
    found = sorted((r.file_id, r.started_us, r.longest_us, r.n) for r in stream.run().where("NOT late").collect())
    wanted = seek.hang_episodes(spark.createDataFrame(rows, SCHEMA), limit)
    assert found == sorted((r.file_id, r.started_us, r.longest_us, r.n) for r in wanted.collect()) and len(found) > 3


@pytest.mark.parametrize("ttl_ms", [0, 3_600_000])
def test_stats_go_on_after_a_restart(spark, tmp_path, ttl_ms):
    stream = Stream(spark, tmp_path, lambda r: stateful.running_stats(r, ttl_ms), "model string, amount bigint", "update", once=ttl_ms > 0)
    stream.put([("a", 5), ("b", 1)])
    stream.put([("a", 7)])
    stream.run()
    stream.put([("a", 1), ("c", 2)])
    found = stream.run()
    last = {r.model: (r.n, r.total) for r in found.groupBy("model").agg(F.max("n").alias("n"), F.max("total_hundredths").alias("total")).collect()}
    assert last == {"a": (3, 13), "b": (1, 1), "c": (1, 2)}


def test_each_frame_comes_once_and_state_shrinks(spark, tmp_path):
    def job(rows):
        timed = rows.withColumn("at", F.timestamp_micros("pts_us"))
        return stateful.drawn_or_missed(timed, timed.withColumn("n", F.when(F.col("active"), F.col("frame_id") * 2)), "200 seconds", "1 minute")

    rows = pings(3)
    stream = Stream(spark, tmp_path, job)
    for part in by_time(rows, 100 * SECOND, 3):
        stream.put(part)
    stream.run()
    stream.put(CLOSE + LAST)
    found = [(r.frame_id, r.n) for r in stream.run().where("frame_id >= 0").collect()]
    assert sorted(found) == sorted((r[1], r[1] * 2 if r[3] else None) for r in rows)
    kept = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in stream.progress if p["stateOperators"]]
    assert max(kept) > 20 and kept[-1] < 10


@pytest.mark.parametrize("kind", ["debounced", "hang_episodes"])
def test_state_doesnt_grow_with_files(spark, tmp_path, kind):
    rng = random.Random(4)
    rows = [(file, file * 10 + k, rng.randrange(900) * SECOND, True) for file in range(1500) for k in range(4)]
    rows += [(7, None, 950 * SECOND, True), (None, 1, 5 * SECOND, True), (8, 2, None, True)]
    rows += [(file, -1, 10**6 * SECOND, False) for file in range(1500)]
    stream = Stream(spark, tmp_path, lambda r: getattr(stateful, kind)(r, 300 * SECOND, "1000 seconds"))
    for part in (rows[:3000], rows[3000:-1500], rows[-1500:] + LAST):
        stream.put(part)
        found = stream.run().where("NOT late").drop("late", "batch", "pts_us")
    wanted = getattr(seek, kind)(spark.createDataFrame(rows, SCHEMA), 300 * SECOND)
    if kind == "debounced":
        found, wanted = found.where("frame_id IS NULL OR frame_id >= 0"), wanted.where("frame_id IS NULL OR frame_id >= 0").select("file_id", "frame_id")
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
    assert max(op["numRowsTotal"] for p in stream.progress for op in p["stateOperators"]) <= 600


def test_frames_meet_detections_of_other_batches(spark, tmp_path):
    rng, within = random.Random(6), 30 * SECOND
    # file_id is a detection's n; ids repeat, so that frames have none, one or several in reach
    rows = [(None if k % 9 == 0 else k, rng.randrange(700), rng.randrange(900) * SECOND, k % 2 == 0) for k in range(6000)]
    parts = by_time(rows, 100 * SECOND, 3, seed=2)
    parts[1] += [(None, 5, None, False), (3, 5, None, True), (None, None, 450 * SECOND, False), (4, None, 450 * SECOND, True)]
    parts += [[(None, -1, 10**6 * SECOND, active) for active in (False, True)], [(None, 8, 1 * SECOND, False), (None, -2, 2 * 10**6 * SECOND, False), (None, -2, 2 * 10**6 * SECOND, True)]]

    def job(r):
        timed = r.withColumn("at", F.timestamp_micros("pts_us")).withColumn("n", F.col("file_id"))
        return stateful.drawn_or_missed(timed.where("NOT active"), timed.where("active"), "200 seconds", "30 seconds")

    stream = Stream(spark, tmp_path, job)
    for part in parts:
        stream.put(part)
        found = stream.run()  # a stop and a restart after each
    given = [r for part in parts for r in part if r[1] is None or r[1] >= 0]
    seen = [r for r in given if r[3] and None not in r]
    wanted = []
    for _, frame, at, active in given:
        if not active:
            # the frame of second 1 that comes last is over, and so are its detections
            n = [] if at in (None, SECOND) and frame in (5, 8) else [d[0] for d in seen if d[1] == frame and at <= d[2] <= at + within]
            wanted += [(frame, k) for k in n or [None]]
    assert sorted(map(str, wanted)) == sorted(str((r.frame_id, r.n)) for r in found.where("frame_id IS NULL OR frame_id >= 0").collect())
    assert max(op["numRowsTotal"] for p in stream.progress for op in p["stateOperators"]) <= 2000


def test_state_has_no_more_partitions_than_tasks(spark, sf_dir, tmp_path, monkeypatch):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(jobs, "_folder", lambda spark: f"file://{tmp_path}/run")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        jobs.running_stats(spark, sf_dir)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert len(glob.glob(f"{tmp_path}/run/state/state/0/[0-9]*")) == 8
