"""A server with a queue of one: a request in flight completes, the newest that waits starts next, the others are superseded.

A request that comes while the server is free starts at once (of those that come at the same
microsecond, the last). One that comes while it is busy waits, in the place of any that waited
before; one that comes when the server gets free counts as waiting.

A file's requests run through a task in order, one at a time, with nothing held but the server's state. A
file of more than ``most`` requests is cut into runs of whole stretches of time (a day by default), so that it
is many tasks. What a run hands to the next is one row: until when the server is busy and which request waits. All
runs first begin with a free server; those whose state before them turns out
otherwise run again, and so on until nothing changes. A server that gets free forgets what came
before, so the rounds are as many as runs in the longest time that a server was never free
at a run's end, at most a file's requests over ``most``; each round runs only those that have changed and keeps
what it found beside the earlier rounds.

Rows with a null file, time or service belong to no queue and are left out; a service below 0
counts as 0. Rows that repeat file, time and frame are one request (the longest service counts).
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framesift.operators import seek
from framesift.sources.shared import checkpoint

#: Requests of a file that one run takes, by default.
MOST = 1 << 20
#: State between runs: when the server gets free; time, frame and service of the request that waits. All null: free, none waits.
_STATE = ("free_us", "at_us", "waiting", "waiting_us")
#: A decided request, or (with a null pts_us) a run's first time and the state after it.
_OUT = ("file_id", "_run", "pts_us", "frame_id", "started_us", "completed_us", "first_us", *_STATE)
_ALWAYS = -(1 << 62)
#: Rows that are handed on at a time.
_BATCH = 10_000


class _Server:
    """One run's server; it puts a row for each request that it decides, and one for the state after the run, into ``out``."""

    def __init__(self, out: list[tuple], key: tuple, first: int, free: int | None, waiting: tuple[int, int, int] | None):
        self.out, self.key, self.first, self.waiting = out, key, first, waiting
        self.free = _ALWAYS if free is None else free

    def arrive(self, request: tuple[int, int, int]) -> None:
        """The next request (time, frame, service): before it comes the one that waits may start, else it is superseded."""
        if self.waiting is not None:
            if request[0] > max(self.free, self.waiting[0]):
                self._start()
            else:
                self.out.append((*self.key, *self.waiting[:2], None, None, *_NONE))
        self.waiting = request

    def _start(self) -> None:
        at = max(self.free, self.waiting[0])
        self.free = at + self.waiting[2]
        self.out.append((*self.key, *self.waiting[:2], at, self.free, *_NONE))
        self.waiting = None

    def end(self, final: bool) -> None:
        """What still waits at the run's end is decided there if nothing later can take its place."""
        if self.waiting is not None and (final or self.free <= self.waiting[0]):
            self._start()
        self.out.append((*self.key, None, None, None, None, self.first, self.free, *(self.waiting or (None, None, None))))


_NONE = (None,) * 5


def _serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decided requests and states after runs, from rows in order."""
    out: list[tuple] = []
    server, key, final, held = None, None, None, None
    names = ("file_id", "_run", "pts_us", "frame_id", "service_us", "_final", *_STATE)
    for batch in batches:
        for file, run, pts, frame, service, last, free, *waiting in zip(*(batch.column(c).to_pylist() for c in names)):
            if (file, run) != key:
                if server:
                    server.arrive(held)
                    server.end(final)
                key, final, held = (file, run), last, None
                server = _Server(out, key, pts, free, None if waiting[0] is None else tuple(waiting))
            # of rows that repeat a request the last has the longest service
            if held is not None and held[:2] != (pts, frame):
                server.arrive(held)
            held = (pts, frame, service)
            if len(out) >= _BATCH:
                yield _batch(out)
                out.clear()
    if server:
        server.arrive(held)
        server.end(final)
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], list(_OUT))


def _served(rows: DataFrame) -> DataFrame:
    """``rows`` (requests with _run, _final and the state before their run) through ``_serve``, one shuffle."""
    ordered = rows.repartition("file_id", "_run").sortWithinPartitions("file_id", "_run", "pts_us", "frame_id", "service_us")
    return ordered.select("file_id", "_run", "pts_us", "frame_id", "service_us", "_final", *_STATE).mapInArrow(_serve, ", ".join(f"{c} bigint" for c in _OUT))


def _handed(states: DataFrame) -> DataFrame:
    """The state that each run gets from the one before it: null where the server is free by its first request."""
    given = states.withColumn("s", F.lag(F.struct(*_STATE)).over(Window.partitionBy("file_id").orderBy("_run")))
    idle = F.col("s.waiting").isNull() & (F.col("s.free_us") <= F.col("first_us"))
    return given.select("file_id", "_run", *[F.when(~idle, F.col(f"s.{c}")).alias(c) for c in _STATE])


def _runs(rows: DataFrame, busy: DataFrame, most: int) -> DataFrame:
    """file_id, _stretch, _run and _final: the stretches of busy files, as many to a run as begin within ``most`` requests."""
    each = rows.join(busy, "file_id", "left_semi").groupBy("file_id", "_stretch").agg(F.count("*").alias("n"))
    order = Window.partitionBy("file_id").orderBy("_stretch")
    each = each.withColumn("_run", F.expr(f"(sum(n) OVER (PARTITION BY file_id ORDER BY _stretch) - n) div {int(most)}"))
    return each.select("file_id", "_stretch", "_run", (F.col("_run") == F.max("_run").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_final"))


def latest_wins(requests: DataFrame, stretch_us: int = seek.DAY, most: int = MOST) -> DataFrame:
    """file_id, frame_id, pts_us, started_us, completed_us and superseded of every request (file_id, frame_id, pts_us, service_us), times null where superseded."""
    rows = requests.select("file_id", "frame_id", "pts_us", "service_us").dropna()
    rows = seek.stretched(rows.withColumn("service_us", F.greatest(F.lit(0), "service_us").cast("bigint")), ["file_id"], "pts_us", stretch_us)
    free = {c: F.lit(None).cast("bigint") for c in _STATE}
    busy = checkpoint(rows.groupBy("file_id").count().where(F.col("count") > most).select("file_id"))
    if not busy.limit(1).count():
        return _decided(_served(rows.withColumns({"_run": F.lit(0).cast("bigint"), "_final": F.lit(True), **free})))
    runs = checkpoint(_runs(rows, busy, most))
    rows = rows.join(runs, ["file_id", "_stretch"], "left").withColumns({"_run": F.coalesce("_run", F.lit(0).cast("bigint")), "_final": F.coalesce("_final", F.lit(True))})
    found = checkpoint(_served(rows.withColumns(free)))
    state = lambda df: df.where("pts_us IS NULL").select("file_id", "_run", "first_us", *_STATE)
    # only busy files hand anything from run to run
    states = state(found).join(runs.select("file_id").distinct(), "file_id", "left_semi")
    before = states.select("file_id", "_run", *[c.alias(n) for n, c in free.items()])
    done = found
    while True:
        new = _handed(states)
        changed = checkpoint(new.exceptAll(before))
        if not changed.limit(1).count():
            return _decided(done)
        keys = changed.select("file_id", "_run")
        found = checkpoint(_served(rows.join(changed, ["file_id", "_run"])))
        # earlier rounds' rows stay where they are, those of runs that have run again are passed over
        done = done.join(keys, ["file_id", "_run"], "left_anti").unionByName(found)
        states = checkpoint(states.join(keys, ["file_id", "_run"], "left_anti").unionByName(state(found)))
        before = checkpoint(before.join(keys, ["file_id", "_run"], "left_anti").unionByName(changed))


def _decided(found: DataFrame) -> DataFrame:
    return found.where("pts_us IS NOT NULL").select("file_id", "frame_id", "pts_us", "started_us", "completed_us", F.col("started_us").isNull().alias("superseded"))
