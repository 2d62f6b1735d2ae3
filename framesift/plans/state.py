"""Queries over cached detections, running statistics, progress and event logs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framesift.functions import timecode
from framesift.operators import cache, progress, queue, seek
from framesift.plans.registry import query
from framesift.sources.shared import shared_folder
from framesift.sources.tables import FRAMES, INFERENCES, MEDIA, TRIMS, frames, inferences, media, table, trims

_FRAMES, _INFER = "WITH " + FRAMES, "WITH " + INFERENCES
_CACHE = """, cached AS (SELECT frame_id AS key, frame_id % 7 AS n, 100 + frame_id % 3 AS cached_at FROM frames WHERE frame_id % 3 <> 0),
fresh AS (SELECT frame_id AS key, frame_id % 11 AS n, 101 + frame_id % 4 AS cached_at FROM frames WHERE frame_id % 2 = 0)
"""


def _tables(spark, sf_dir):
    rows = frames(spark, sf_dir)
    cached = rows.where("frame_id % 3 <> 0").select(F.col("frame_id").alias("key"), F.expr("frame_id % 7").alias("n"), F.expr("100 + frame_id % 3").alias("cached_at"))
    fresh = rows.where("frame_id % 2 = 0").select(F.col("frame_id").alias("key"), F.expr("frame_id % 11").alias("n"), F.expr("101 + frame_id % 4").alias("cached_at"))
    return rows, cached, fresh


@query(_FRAMES + _CACHE + "SELECT frame_id, n, n IS NOT NULL AS hit FROM frames LEFT JOIN cached ON frame_id = key")
def cache_lookup(spark, sf_dir):
    rows, cached, _ = _tables(spark, sf_dir)
    return cache.lookup(rows.withColumnRenamed("frame_id", "key"), cached).select(F.col("key").alias("frame_id"), "n", "hit")


@query(_FRAMES + _CACHE + "SELECT frame_id FROM frames WHERE frame_id NOT IN (SELECT key FROM cached)")
def cache_misses(spark, sf_dir):
    rows, cached, _ = _tables(spark, sf_dir)
    return cache.misses(rows.withColumnRenamed("frame_id", "key"), cached).select(F.col("key").alias("frame_id"))


@query(_FRAMES + """, k AS (SELECT frame_id, frame_id % 3 <> 0 AS held, frame_id % 15 = 0 AS given FROM frames)
SELECT frame_id, CASE WHEN held THEN frame_id % 7 WHEN given THEN 99 ELSE frame_id * 13 % 11 END AS n,
  CASE WHEN held THEN 'cache' WHEN given THEN 'override' ELSE 'computed' END AS first_source, 'cache' AS second_source FROM k""")
def read_through(spark, sf_dir):
    """Detections of every frame through the cache, twice: the first run computes what is missing and stores it, the second finds all."""
    rows = frames(spark, sf_dir).select(F.col("frame_id").alias("key"))
    held = cache.DetectionCache(spark, shared_folder(spark, "cache"), "n bigint, source string")
    held.put(rows.where("key % 3 <> 0").select("key", F.expr("key % 7").alias("n"), F.lit("computed").alias("source")), "given")
    compute = lambda missing: missing.select("key", F.expr("key * 13 % 11").alias("n"))
    override = rows.where("key % 15 = 0").distinct().select("key", F.lit(99).cast("bigint").alias("n"))
    first = held.read_through(rows, compute, "run-1", override).withColumnRenamed("source", "first_source")
    second = held.read_through(rows, compute, "run-2").select("key", F.col("source").alias("second_source"))
    return first.join(second, "key").select(F.col("key").alias("frame_id"), "n", "first_source", "second_source")


@query(_FRAMES + _CACHE + """, u AS (SELECT *, 0 AS side FROM cached UNION ALL SELECT *, 1 FROM fresh)
SELECT key, n, cached_at FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY cached_at DESC, side DESC) = 1""")
def upsert_latest(spark, sf_dir):
    _, cached, fresh = _tables(spark, sf_dir)
    return cache.upsert(cached, fresh).select("key", "n", "cached_at")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT starts_with(o_orderpriority, '1-')")
def prefix_delete(spark, sf_dir):
    return cache.without_prefix(table(spark, sf_dir, "orders"), "o_orderpriority", "1-").select("o_orderkey", "o_orderpriority")


@query(_FRAMES + """, d AS (SELECT DISTINCT file_id FROM frames), p AS (SELECT file_id, epoch_us(TIMESTAMP '2024-01-05') + k * 86400000000 AS at_us FROM d, (VALUES (0), (3), (7)) t(k))
SELECT p.file_id, at_us, f.frame_id, f.pts_us FROM p ASOF LEFT JOIN frames f ON p.file_id = f.file_id AND p.at_us >= f.pts_us""")
def seek_asof(spark, sf_dir):
    """The latest frame at or before each probe of its file."""
    rows = frames(spark, sf_dir)
    days = F.explode(F.array(*(F.lit(k * 86_400_000_000) for k in (0, 3, 7))))
    start = F.unix_micros(F.lit("2024-01-05 00:00:00").cast("timestamp"))
    probes = rows.select("file_id").distinct().withColumn("k", days).select("file_id", (start + F.col("k")).alias("at_us"))
    return seek.latest_before(probes, rows.select("file_id", "frame_id", "pts_us"))


@query(_INFER + ", s AS (SELECT model, count(*) AS n, sum(CAST(round(ms * 100) AS BIGINT)) AS c FROM inferences GROUP BY model), m AS (SELECT unnest(['detect_n', 'detect_x', 'detect_z']) AS model) SELECT m.model, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(c, 0) AS BIGINT) AS total_hundredths, c / n::DOUBLE AS average FROM m LEFT JOIN s USING (model)")
def inference_stats(spark, sf_dir):
    """Count, total and average of every model, with rows for models that never ran."""
    return progress.inference_totals(inferences(spark, sf_dir), ["detect_n", "detect_x", "detect_z"])


@query(_INFER + ", c AS (SELECT *, CAST(round(ms * 100) AS BIGINT) AS h FROM inferences) SELECT seq, model, sum(h) OVER w / count(*) OVER w::DOUBLE AS average FROM c WINDOW w AS (PARTITION BY model, file_id ORDER BY pts_us, seq ROWS UNBOUNDED PRECEDING)".replace("count(*) OVER w::DOUBLE", "CAST(count(*) OVER w AS DOUBLE)"))
def running_average(spark, sf_dir):
    return progress.running_average(inferences(spark, sf_dir), ["model", "file_id"]).select("seq", "model", "average")


@query(_INFER + ", s AS (SELECT file_id, sum(CAST(round(ms * 100) AS BIGINT)) FILTER (WHERE model = 'detect_x') AS f, sum(CAST(round(ms * 100) AS BIGINT)) FILTER (WHERE model = 'detect_n') AS e FROM inferences GROUP BY file_id) SELECT file_id, CASE WHEN f > 0 THEN f / CAST(f + coalesce(e, 0) AS DOUBLE) ELSE 0.1::DOUBLE END AS fraction FROM s")
def finalization_fraction(spark, sf_dir):
    cents = F.round(F.col("ms") * 100).cast("bigint")
    sums = inferences(spark, sf_dir).groupBy("file_id").agg(
        F.sum(F.when(F.col("model") == "detect_x", cents)).alias("f"), F.sum(F.when(F.col("model") == "detect_n", cents)).alias("e")
    )
    return sums.select("file_id", progress.finalization_fraction(F.col("f"), F.col("e")).alias("fraction"))


_ETA = "WITH " + MEDIA + """, i AS (SELECT pos, is_video, CAST(pos % 101 AS DOUBLE) / 100 AS p, CAST(pos * 13 % 90000 AS DOUBLE) AS elapsed, CASE WHEN is_video AND pos % 9 <> 0 THEN duration_s * 30 * 12.5::DOUBLE ELSE 0::DOUBLE END AS est FROM media),
eta AS (SELECT *, CASE WHEN p > 0.01::DOUBLE THEN elapsed * (1 - p) / p WHEN est > 0 THEN est * (1 - p) END AS remaining FROM i)
"""


def _items(spark, sf_dir):
    rows = media(spark, sf_dir)
    est = F.when(F.col("is_video") & F.expr("pos % 9 <> 0"), progress.file_estimate(F.col("duration_s"), F.lit(12.5))).otherwise(F.lit(0.0))
    rows = rows.select("pos", F.expr("double(pos % 101) / 100").alias("p"), F.expr("double(pos * 13 % 90000)").alias("elapsed"), est.alias("est"))
    return rows.withColumn("remaining", progress.file_remaining(F.col("p"), F.col("elapsed"), F.col("est")))


@query(_ETA + """, s AS (SELECT *, CAST(floor(remaining / 1000 + 0.5) AS BIGINT) AS s FROM eta)
SELECT pos, remaining, CASE WHEN s < 5 THEN 'almost done' WHEN s < 60 THEN '~' || s || 's' ELSE '~' || (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' END AS text FROM s""")
def file_eta(spark, sf_dir):
    return _items(spark, sf_dir).select("pos", "remaining", timecode.eta_text(F.col("remaining")).alias("text"))


@query(_ETA + """, b AS (SELECT *, pos // 32 AS batch FROM eta), g AS (SELECT *, sum(CASE WHEN est > 0 THEN floor(est) ELSE 5000 END) OVER (PARTITION BY batch ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM b)
SELECT pos, CASE WHEN coalesce(remaining, CASE WHEN est > 0 THEN est END) IS NOT NULL THEN floor(coalesce(remaining, CASE WHEN est > 0 THEN est END)) + coalesce(later, 0) END AS remaining FROM g""")
def global_eta(spark, sf_dir):
    """What is left of the current file and the estimates of those after it in its batch."""
    return progress.batch_remaining(_items(spark, sf_dir).withColumn("batch", F.expr("pos div 32")), F.lit(5000.0)).select("pos", F.col("remaining_all").alias("remaining"))


@query("WITH " + MEDIA + """, c AS (SELECT pos, pos % 2 = 0 AS exported, CASE pos % 5 WHEN 0 THEN ['keepAudio'] WHEN 1 THEN ['drawMode', 'keepAudio'] WHEN 2 THEN ['namingPattern', 'exportMode'] WHEN 3 THEN ['minConfidence'] ELSE [] END AS keys FROM media)
SELECT pos, exported AND len(keys) = 0 AS exported, len(list_filter(keys, lambda k: k NOT IN ('keepMetadata', 'keepAudio', 'exportMode', 'namingPattern'))) > 0 AS redraw FROM c""")
def dirty_after_config(spark, sf_dir):
    """Any change of settings makes items unexported; changes that only concern the export don't redraw."""
    keys = F.expr("case pos % 5 when 0 then array('keepAudio') when 1 then array('drawMode', 'keepAudio') when 2 then array('namingPattern', 'exportMode') when 3 then array('minConfidence') else array() end")
    return media(spark, sf_dir).select("pos", progress.still_exported(F.expr("pos % 2 = 0"), keys).alias("exported"), progress.needs_redraw(keys).alias("redraw"))


@query(_FRAMES + ", n AS (SELECT *, lead(pts_us) OVER (PARTITION BY file_id ORDER BY pts_us, frame_id) AS later FROM frames) SELECT file_id, frame_id FROM n WHERE later IS NULL OR later - pts_us >= 7200000000")
def debounce_events(spark, sf_dir):
    return seek.debounced(frames(spark, sf_dir), 7_200_000_000).select("file_id", "frame_id")


@query(_FRAMES + """, g AS (SELECT *, pts_us - lag(pts_us) OVER (PARTITION BY file_id ORDER BY pts_us, frame_id) AS gap, event_type <> 'signup' AS active FROM frames),
h AS (SELECT *, gap > 3600000000 AND active AS hang FROM g), e AS (SELECT *, sum(CASE WHEN hang THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY pts_us, frame_id ROWS UNBOUNDED PRECEDING) AS episode FROM h)
SELECT file_id, CAST(min(pts_us - gap) AS BIGINT) AS started_us, CAST(max(gap) AS BIGINT) AS longest_us, count(*) AS n FROM e WHERE hang GROUP BY file_id, episode""")
def hang_episodes(spark, sf_dir):
    """Runs of pings that come late, while the window is active: start, longest lag and number."""
    return seek.hang_episodes(frames(spark, sf_dir).withColumn("active", F.col("event_type") != "signup"), 3_600_000_000)


@query(_FRAMES + ", b AS (SELECT *, pts_us // 21600000000 AS slot FROM frames) SELECT file_id, slot, max(frame_id) AS frame_id, count(*) - 1 AS dropped FROM b GROUP BY file_id, slot")
def latest_request(spark, sf_dir):
    """Of the requests of a time slot only the latest is served."""
    rows = frames(spark, sf_dir).withColumn("slot", F.expr("pts_us div 21600000000"))
    return rows.groupBy("file_id", "slot").agg(F.max("frame_id").alias("frame_id"), (F.count("*") - 1).alias("dropped"))


@query("WITH RECURSIVE " + FRAMES + """, q AS (SELECT file_id, frame_id, pts_us, CAST(round(value * 100) AS BIGINT) * 3600000 AS service_us FROM frames),
l AS MATERIALIZED (SELECT file_id, list(pts_us ORDER BY pts_us, frame_id) AS t, list(frame_id ORDER BY pts_us, frame_id) AS f, list(service_us ORDER BY pts_us, frame_id) AS s FROM q GROUP BY file_id),
z AS (SELECT file_id, len(list_filter(t, lambda x: x <= t[1])) AS i, t[1] AS started FROM l
  UNION ALL
  SELECT z.file_id,
    CASE WHEN len(list_filter(l.t, lambda x: x <= z.started + l.s[z.i])) > z.i THEN len(list_filter(l.t, lambda x: x <= z.started + l.s[z.i])) ELSE len(list_filter(l.t, lambda x: x <= l.t[z.i + 1])) END,
    CASE WHEN len(list_filter(l.t, lambda x: x <= z.started + l.s[z.i])) > z.i THEN z.started + l.s[z.i] ELSE l.t[z.i + 1] END
  FROM z JOIN l USING (file_id) WHERE z.i < len(l.t)),
a AS (SELECT z.file_id, l.f[z.i] AS frame_id, z.started AS started_us, z.started + l.s[z.i] AS completed_us FROM z JOIN l USING (file_id))
SELECT q.file_id, q.frame_id, q.pts_us, started_us, completed_us, started_us IS NULL AS superseded FROM q LEFT JOIN a USING (file_id, frame_id)""")
def request_queue(spark, sf_dir):
    """Requests of each file at a server with a queue of one: when each starts and completes, or that a newer one takes its place."""
    service = F.round(F.col("value") * 100).cast("bigint") * 3_600_000
    return queue.latest_wins(frames(spark, sf_dir).withColumn("service_us", service))


@query(_FRAMES + ", r AS (SELECT file_id, frame_id, row_number() OVER (PARTITION BY file_id ORDER BY pts_us DESC, frame_id DESC) AS n FROM frames) SELECT file_id, frame_id, n FROM r WHERE n <= 1000")
def log_ring(spark, sf_dir):
    """The last thousand entries of each log."""
    return seek.latest_entries(frames(spark, sf_dir)).select("file_id", "frame_id", F.col("n").cast("bigint").alias("n"))


@query(_FRAMES + ", f AS (SELECT *, min(pts_us) OVER (PARTITION BY file_id) AS start FROM frames) SELECT frame_id, (pts_us - start) / 1000::DOUBLE AS target_ms, 1000 + (pts_us - start) / 1000::DOUBLE < 5000000 AS late FROM f")
def frame_pacing(spark, sf_dir):
    """When each frame is due after playback starts, and whether it is late by a fixed clock."""
    return seek.paced(frames(spark, sf_dir), F.lit(5_000_000.0), F.lit(1000.0)).select("frame_id", "target_ms", "late")


@query("SELECT event_id, CASE WHEN value >= 50 THEN (1 - 0.1::DOUBLE) + least((value - 50) / 100::DOUBLE, 0.99::DOUBLE) * 0.1::DOUBLE ELSE value / 50::DOUBLE * (1 - 0.1::DOUBLE) END AS progress FROM events")
def progress_remap(spark, sf_dir):
    """Encoding fills the first part of the bar, finalization the rest by the clock, up to 99 %."""
    done, waited = F.col("value") / 50.0, F.col("value") - 50
    return table(spark, sf_dir, "events").select("event_id", progress.remapped(done, waited, F.lit(100.0), F.lit(0.1)).alias("progress"))


@query("WITH RECURSIVE " + FRAMES + """, o AS (SELECT file_id, frame_id % 5 AS key, event_type <> 'click' AS is_get, row_number() OVER (PARTITION BY file_id ORDER BY pts_us, frame_id) AS i FROM frames),
z AS (SELECT file_id, max(i) AS n FROM o GROUP BY file_id),
s AS (SELECT file_id, 0::BIGINT AS i, []::BIGINT[] AS m, 0::BIGINT AS hits FROM z UNION ALL
  SELECT s.file_id, o.i, CASE WHEN o.is_get THEN CASE WHEN list_contains(s.m, o.key) THEN list_append(list_filter(s.m, lambda k: k <> o.key), o.key) ELSE s.m END
    WHEN list_contains(s.m, o.key) THEN s.m WHEN len(s.m) >= 3 THEN list_append(s.m[2:], o.key) ELSE list_append(s.m, o.key) END,
    s.hits + CASE WHEN o.is_get AND list_contains(s.m, o.key) THEN 1 ELSE 0 END FROM s JOIN o ON o.file_id = s.file_id AND o.i = s.i + 1)
SELECT s.file_id, array_to_string(m, ',') AS keys, hits FROM s JOIN z ON z.file_id = s.file_id AND z.n = s.i""")
def lru_replay(spark, sf_dir):
    """Keys of a three-entry cache, oldest first, after each file's accesses, and its hits."""
    rows = frames(spark, sf_dir).select("file_id", F.expr("frame_id % 5").alias("key"), (F.col("event_type") != "click").alias("is_get"), "pts_us", "frame_id")
    found = cache.replay(rows, ["pts_us", "frame_id"], capacity=3)
    return found.select("file_id", F.array_join("keys", ",").alias("keys"), "hits")


@query("WITH " + MEDIA + ", " + TRIMS + ", x AS (SELECT media.pos, is_video, media.pos % 4 = 1 AS exported, t0 FROM media LEFT JOIN trims ON media.pos = trims.pos) SELECT pos FROM x WHERE NOT exported")
def pending_export(spark, sf_dir):
    rows = media(spark, sf_dir).join(trims(spark, sf_dir), "pos", "left").withColumn("exported", F.expr("pos % 4 = 1"))
    return progress.pending(rows).select("pos")


@query("WITH " + MEDIA + ", b AS (SELECT pos // 64 AS batch, pos % 13 = 0 AS failed, is_video FROM media) SELECT batch, count(*) AS completed, count(*) FILTER (WHERE failed) AS failures, bool_and(NOT failed) AS all_exported, bool_or(is_video) AS any_video FROM b GROUP BY batch")
def batch_progress(spark, sf_dir):
    rows = media(spark, sf_dir).select(F.expr("pos div 64").alias("batch"), F.expr("pos % 13 = 0").alias("failed"), "is_video")
    return rows.groupBy("batch").agg(
        F.count("*").alias("completed"), F.count(F.when(F.col("failed"), 1)).alias("failures"), F.bool_and(~F.col("failed")).alias("all_exported"), F.bool_or("is_video").alias("any_video")
    )


@query("SELECT event_id, CASE WHEN n = 1 THEN -1 WHEN r < a THEN a - 1 WHEN r = a THEN least(r, n - 2) ELSE a END AS active FROM (SELECT event_id, event_id % 6 + 1 AS n, event_id * 7 % (event_id % 6 + 1) AS r, event_id * 11 % (event_id % 6 + 1) AS a FROM events)")
def active_after_removal(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr("event_id % 6 + 1").alias("n"), F.expr("event_id * 7 % (event_id % 6 + 1)").alias("r"), F.expr("event_id * 11 % (event_id % 6 + 1)").alias("a"))
    return rows.select("event_id", progress.active_after_removal(F.col("n"), F.col("a"), F.col("r")).alias("active"))
