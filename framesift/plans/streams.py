"""Streaming queries, each run to the end of its input and returned as the table it has written."""

from __future__ import annotations

from framesift.plans import state  # noqa: F401  (its SQL is used here)
from framesift.plans.registry import ORACLES, query
from framesift.sources.tables import FRAMES, INFERENCES
from framesift.streaming import jobs


@query("WITH " + INFERENCES + ", c AS (SELECT model, CAST(round(ms * 100) AS BIGINT) AS h FROM inferences) SELECT model, count(*) AS n, CAST(sum(h) AS BIGINT) AS total_hundredths FROM c GROUP BY model")
def stream_stats(spark, sf_dir):
    """Running count and total of each model, kept as state over micro-batches."""
    return jobs.stats(spark, sf_dir)


@query("WITH " + FRAMES + ", b AS (SELECT *, pts_us // 21600000000 AS slot FROM frames) SELECT file_id, slot, max(frame_id) AS frame_id FROM b GROUP BY file_id, slot")
def stream_latest_wins(spark, sf_dir):
    """The latest request of each file and time slot."""
    return jobs.latest(spark, sf_dir)


@query("WITH " + FRAMES + " SELECT pts_us // 3600000000 * 3600000000 AS window_us, event_type, count(*) AS n FROM frames GROUP BY ALL")
def stream_window_counts(spark, sf_dir):
    """Events of each hour and type."""
    return jobs.window_counts(spark, sf_dir)


@query("WITH " + FRAMES + " SELECT file_id, max(frame_id % 97) AS generation, count(*) AS n FROM frames GROUP BY file_id")
def stream_generations(spark, sf_dir):
    """The highest generation seen of each file, and the number of results: older ones are stale."""
    return jobs.generations(spark, sf_dir)


@query("WITH " + FRAMES + ", cached AS (SELECT frame_id AS key, frame_id % 7 AS n FROM frames WHERE frame_id % 3 <> 0) SELECT frame_id, coalesce(n, -1) AS n, n IS NOT NULL AS drawn FROM frames LEFT JOIN cached ON frame_id = key")
def stream_playback(spark, sf_dir):
    """Each frame once, with its cached detections; frames without are left to be inferred."""
    return jobs.playback(spark, sf_dir)


@query(ORACLES["debounce_events"])
def stream_debounce(spark, sf_dir):
    """Events that none of their file follows within two hours, decided by event-time timers over several micro-batches and a restart."""
    return jobs.debounced(spark, sf_dir, 7_200_000_000)


@query(ORACLES["hang_episodes"])
def stream_hangs(spark, sf_dir):
    """Runs of late pings, closed by event-time timers over several micro-batches and a restart."""
    return jobs.hang_episodes(spark, sf_dir, 3_600_000_000)


@query(ORACLES["stream_stats"])
def stream_running_stats(spark, sf_dir):
    """Running count and total of each model as value state in RocksDB, over several micro-batches and a restart."""
    return jobs.running_stats(spark, sf_dir)


@query(ORACLES["stream_playback"])
def stream_misses(spark, sf_dir):
    """Frames joined to the stream of their detections: each once, without detections once the watermark rules them out."""
    return jobs.misses(spark, sf_dir)
