"""Stateful processors with RocksDB state: running statistics that expire, debounce by event-time timers.

State is kept by key in Spark's RocksDB state store, whose changes go to the checkpoint with every
micro-batch, so a query that is stopped or loses an executor goes on where it was. Event-time
timers fire when the watermark passes them: a decision that later rows could change is taken only
then, in whatever order the micro-batches bring the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB; the caller's settings stay."""
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return session


class RunningStats(StatefulProcessor):
    """n and total of each key's whole numbers, as a value state that is forgotten ``ttl_ms`` after its last change (0: never)."""

    def __init__(self, ttl_ms: int = 0):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sums", "n bigint, total bigint", self.ttl_ms or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total = self.state.get() if self.state.exists() else (0, 0)
        for part in rows:
            n, total = n + len(part), total + int(part["amount"].sum())
        self.state.update((n, total))
        yield pd.DataFrame({"model": [key[0]], "n": [n], "total_hundredths": [total]})

    def close(self) -> None:
        pass


class _Ordered(StatefulProcessor):
    """Holds rows until the watermark has passed them by ``wait_us``, then takes each file's in order; late rows go out at once.

    A row behind the watermark is late: it decides nothing. A key is a group of files, as every question to
    the state store costs far more than a row: their rows are held as whole numbers, one binary value
    for each micro-batch, and a timer stands for the earliest. A group's rows held have to fit one task.
    """

    columns: tuple[str, ...] = ("file_id", "pts_us", "frame_id")
    schema = ""
    wait_us = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", "rows binary")

    def _wake(self, rows: np.ndarray) -> None:
        at = (int(rows[:, 1].min()) + self.wait_us) // 1000 + 1
        # an earlier timer registers the next one
        if not any(timer <= at for timer in self.handle.listTimers()):
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        given = np.concatenate([np.stack([part[c].to_numpy(np.int64) for c in self.columns], axis=1) for part in rows])
        late = given[:, 1] < passed
        if not late.all():
            self.held.appendValue((given[~late].tobytes(),))
            self._wake(given[~late])
        if late.any():
            yield self.late(given[late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = np.frombuffer(b"".join(bytes(r[0]) for r in self.held.get()), np.int64).reshape(-1, len(self.columns))
        if not (rows[:, 1] + self.wait_us < passed).any():
            return
        rows = rows[np.lexsort(rows.T[::-1])]
        ready = rows[:, 1] + self.wait_us < passed
        if ready.all():
            self.held.clear()
        else:
            self.held.put([(rows[~ready].tobytes(),)])
            # the timer that has expired is still listed
            self.handle.registerTimer((int(rows[~ready, 1].min()) + self.wait_us) // 1000 + 1)
        found = self.take(rows, ready)
        if len(found):
            yield found

    def late(self, rows: np.ndarray) -> pd.DataFrame:
        raise NotImplementedError

    def take(self, rows: np.ndarray, ready: np.ndarray) -> pd.DataFrame:
        """What the rows that are ready decide, of rows by file and time."""
        raise NotImplementedError

    def close(self) -> None:
        pass

    def over(self, rows: DataFrame, delay: str, groups: int) -> DataFrame:
        """A stream of the columns as one of what the processor hands on; rows without a file or a time belong to no sequence and go, as in the batch form."""
        known = rows.dropna(subset=["file_id", "pts_us"]).withColumn("frame_id", F.coalesce("frame_id", F.lit(_NONE)))
        whole = clocked(known.select(*(F.col(c).cast("bigint").alias(c) for c in self.columns)), delay)
        grouped = whole.withColumn("_files", F.pmod(F.hash("file_id"), F.lit(groups))).groupBy("_files")
        return grouped.transformWithStateInPandas(self, self.schema, "append", "eventtime")


#: Groups of files that share a value of state.
GROUPS = 512
#: Stands for a null among the rows held: nulls come first, as in the batch form.
_NONE = -(1 << 63)


class Debounce(_Ordered):
    """Of each file's rows (pts_us, frame_id), those that no other of the file follows within the wait."""

    schema = "file_id bigint, pts_us bigint, frame_id bigint, late boolean"

    def __init__(self, wait_us: int):
        self.wait_us = wait_us

    def take(self, rows, ready):
        alone = ready.copy()
        alone[:-1] &= (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) >= self.wait_us)
        return self._frame(rows[alone], False)

    def late(self, rows):
        return self._frame(rows, True)

    def _frame(self, rows: np.ndarray, late: bool) -> pd.DataFrame:
        return pd.DataFrame({c: rows[:, k] for k, c in enumerate(self.columns)} | {"late": np.full(len(rows), late)})


class HangEpisodes(_Ordered):
    """Runs of each file's pings (pts_us, frame_id, active) that come later than the limit after the one before: one row when a ping in time ends the run."""

    columns = ("file_id", "pts_us", "frame_id", "active")
    schema = "file_id bigint, started_us bigint, longest_us bigint, n bigint, late boolean"

    def __init__(self, limit_us: int):
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.runs = handle.getValueState("runs", "file_last_started_longest_n binary")

    def take(self, rows, ready):
        runs = np.frombuffer(bytes(self.runs.get()[0]), np.int64).reshape(-1, 5).tolist() if self.runs.exists() else []
        known, ended = {run[0]: run[1:] for run in runs}, []
        for file, pts, _, active in rows[ready].tolist():
            last, started, longest, n = known.get(file, (None, 0, 0, 0))
            if last is not None and pts - last > self.limit_us and active:
                started = started if n else last
                longest, n = max(longest, pts - last), n + 1
            elif n:
                ended.append((file, started, longest, n))
                longest = n = 0
            known[file] = pts, started, longest, n
        self.runs.update((np.array([(file, *run) for file, run in known.items()], np.int64).tobytes(),))
        return self._frame(ended, False)

    def late(self, rows):
        return self._frame([(file, pts, None, None) for file, pts in rows[:, :2].tolist()], True)

    def _frame(self, rows: list[tuple], late: bool) -> pd.DataFrame:
        columns = {c: pd.array([r[k] for r in rows], "Int64") for k, c in enumerate(("file_id", "started_us", "longest_us", "n"))}
        return pd.DataFrame(columns | {"late": np.full(len(rows), late)})


def running_stats(rows: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """A stream of model and amount as a stream of model, n and total_hundredths after each micro-batch."""
    return rows.groupBy("model").transformWithStateInPandas(RunningStats(ttl_ms), "model string, n bigint, total_hundredths bigint", "update", "processingtime" if ttl_ms else "none")


def clocked(rows: DataFrame, delay: str) -> DataFrame:
    """``rows`` (pts_us, ...) with a watermark on their time. The column it stands on goes, so that Spark leaves rows behind it to the processor, which hands them on as late."""
    return rows.withColumn("_clock", F.timestamp_micros("pts_us")).withWatermark("_clock", delay).drop("_clock")


def debounced(rows: DataFrame, wait_us: int, delay: str, groups: int = GROUPS) -> DataFrame:
    """A stream of file_id, pts_us and frame_id as one of the rows that none of their file follows within the wait, and of late rows."""
    return Debounce(wait_us).over(rows, delay, groups).withColumn("frame_id", F.nullif("frame_id", F.lit(_NONE)))


def hang_episodes(rows: DataFrame, limit_us: int, delay: str, groups: int = GROUPS) -> DataFrame:
    """A stream of file_id, pts_us, frame_id and active as one of ended episodes (started_us, longest_us, n), and of late rows (started_us: their time)."""
    return HangEpisodes(limit_us).over(rows.withColumn("active", F.coalesce("active", F.lit(False))), delay, groups)


class DrawnOrMissed(StatefulProcessor):
    """Pairs of frames and detections as they come; a frame that has none goes out when the watermark passes the end of its time.

    Rows are held by groups of frames as one binary value for each micro-batch, as in ``_Ordered``: Spark's own outer join of two
    streams asks the state store several times a row and goes through all state in every micro-batch. Both sides are held
    until the watermark passes their ``until_us``, so that a frame's detections are still there when it is decided.
    """

    columns = ("frame_id", "at_us", "until_us", "n")
    schema = "frame_id bigint, n bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", "rows binary")

    def _held(self) -> np.ndarray:
        return np.frombuffer(b"".join(bytes(r[0]) for r in self.rows.get()), np.int64).reshape(-1, len(self.columns))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        given = np.concatenate([np.stack([part[c].to_numpy(np.int64) for c in self.columns], axis=1) for part in rows])
        held, over = self._held(), given[:, 2] <= passed
        (old_frames, old_found), (frames, found) = self._sides(held), self._sides(given)
        for left, right in ((frames, np.concatenate([old_found, found])), (old_frames, found)):
            at, size, order = self._near(left, right)
            if size.any():
                first = np.repeat(at - np.cumsum(size) + size, size)
                yield self._frame(np.repeat(left[:, 0], size), right[order[first + np.arange(len(first))], 3])
            if left is frames and (gone := (size == 0) & (frames[:, 2] <= passed)).any():
                yield self._frame(frames[gone, 0], None)
        given = given[~over]
        if not len(given):
            return
        self.rows.appendValue((given.tobytes(),))
        due = int(given[:, 2].min()) // 1000 + 1
        # an earlier timer registers the next one
        if not len(held) or due < int(held[:, 2].min()) // 1000 + 1:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, rows = timerValues.getCurrentWatermarkInMs() * 1000, self._held()
        ready = rows[:, 2] <= passed
        if not ready.any():
            return
        if ready.all():
            self.rows.clear()
        else:
            self.rows.put([(rows[~ready].tobytes(),)])
            self.handle.registerTimer(int(rows[~ready, 2].min()) // 1000 + 1)
        frames, found = self._sides(rows)
        frames = frames[frames[:, 2] <= passed]
        missed = frames[self._near(frames, found)[1] == 0, 0]
        if len(missed):
            yield self._frame(missed, None)

    @staticmethod
    def _sides(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = rows[:, 3] != _NONE
        return rows[~seen], rows[seen]

    @staticmethod
    def _near(frames: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each frame, where its detections begin and how many they are, in the order of ``found`` that comes third."""
        # a frame's time sorts before equal times of detections, its end after them
        kinds = np.repeat(np.array([0, 1, 2], np.int8), (len(frames), len(found), len(frames)))
        times = np.concatenate([frames[:, 1], found[:, 1], frames[:, 2]])
        order = np.lexsort((kinds, times, np.concatenate([frames[:, 0], found[:, 0], frames[:, 0]])))
        before = np.empty(len(order), np.int64)
        before[order] = np.cumsum(kinds[order] == 1)
        begin = before[: len(frames)]
        return begin, before[len(frames) + len(found) :] - begin, order[kinds[order] == 1] - len(frames)

    def _frame(self, ids: np.ndarray, n: np.ndarray | None) -> pd.DataFrame:
        return pd.DataFrame({"frame_id": ids, "n": pd.array([None] * len(ids) if n is None else n, "Int64")})

    def close(self) -> None:
        pass


def drawn_or_missed(frames: DataFrame, detections: DataFrame, delay: str, within: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """Frames (frame_id, at) joined to detections (frame_id, at, n) that come up to ``within`` after them: each frame once, with n, or null once the watermark rules one out.

    Both sides' state goes when the watermark passes it. The watermark follows the slower stream, so
    detections that bring nothing have to go on telling the time: their rows with a null n do only that.
    A frame with several detections comes with each. A frame whose time is over when it comes, or that has
    no time, goes out at once, with what is held then or without.
    """
    until = F.col("at") + F.expr(f"INTERVAL {within}")
    whole = lambda rows, n: rows.select(F.coalesce("frame_id", F.lit(_NONE)).alias("frame_id"), *(F.coalesce(F.unix_micros(c), F.lit(_NONE)).alias(k) for c, k in ((F.col("at"), "at_us"), (until, "until_us"))), n.cast("bigint").alias("n"))
    left = frames.select("frame_id", "at").withWatermark("at", delay)
    # the condition names the time, so that it stays above the watermark
    real = F.when(F.col("at").isNotNull(), F.col("n").isNotNull() & F.col("frame_id").isNotNull())
    right = detections.select("frame_id", "at", "n").withWatermark("at", delay).where(real)
    both = whole(left, F.lit(_NONE)).unionByName(whole(right, F.col("n")))
    grouped = both.withColumn("_frames", F.pmod(F.hash("frame_id"), F.lit(groups))).groupBy("_frames")
    found = grouped.transformWithStateInPandas(DrawnOrMissed(), DrawnOrMissed.schema, "append", "eventtime")
    return found.select(F.nullif("frame_id", F.lit(_NONE)).alias("frame_id"), "n")
