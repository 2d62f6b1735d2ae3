"""Queries over export batches, logs, chunks and frame signatures."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framesift.functions import media as m
from framesift.functions import naming, timecode
from framesift.operators import export, inference, progress, seek
from framesift.plans.registry import query
from framesift.sources.tables import FRAMES, MEDIA, TRIMS, frames, media, table, trims

_MEDIA, _FRAMES = "WITH " + MEDIA, "WITH " + FRAMES


_RUN = _MEDIA + """, a AS (SELECT *, pos // 50 AS batch, pos % 50 = 46 OR pos % 350 = 20 AS aborted FROM media),
b AS (SELECT *, min(pos) FILTER (WHERE aborted) OVER (PARTITION BY batch) AS first FROM a),
s AS (SELECT *, CASE WHEN coalesce(pos >= first, false) THEN 'cancelled' WHEN pos % 7 = 0 THEN 'error' ELSE 'ok' END AS status FROM b)
"""


def _run(spark, sf_dir, output):
    rows = media(spark, sf_dir).withColumn("batch", F.expr("pos div 50"))
    return export.run_batch(rows, ["batch"], "pos", output, F.when(F.expr("pos % 7 = 0"), "not a media file"), F.expr("pos % 50 = 46 or pos % 350 = 20"))


@query(_RUN + r"""SELECT pos, status, CASE WHEN status = 'error' THEN 'not a media file' END AS error, CASE WHEN status = 'ok' THEN regexp_replace(name, '\.[^.]+$', '') || CASE WHEN is_video THEN '.mp4' ELSE '.jpg' END END AS output FROM s""")
def batch_export(spark, sf_dir):
    """Status and output name of every item: bad files fail alone, the first abort of a batch cancels it from there on."""
    name = F.concat(naming.stem(F.col("name")), F.when(F.col("is_video"), ".mp4").otherwise(".jpg"))
    return _run(spark, sf_dir, name).select("pos", "status", "error", "output")


@query(_RUN + "SELECT batch, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status = 'cancelled') AS cancelled, count(*) FILTER (WHERE status <> 'cancelled') AS completed FROM s GROUP BY batch")
def batch_summary(spark, sf_dir):
    return export.summary(_run(spark, sf_dir, F.col("name")), ["batch"])


@query(_RUN + ", " + TRIMS + """, x AS (SELECT s.pos, status, t0, t1, CASE WHEN s.pos % 6 = 1 THEN t1 + 1 ELSE t1 END AS t1_now FROM s LEFT JOIN trims ON s.pos = trims.pos)
SELECT pos, status = 'ok' AND t1 IS NOT DISTINCT FROM t1_now AS exported FROM x""")
def exported_after_run(spark, sf_dir):
    """An item counts as exported where its work succeeded and its trim is still the one it was exported with."""
    rows = _run(spark, sf_dir, F.col("name")).join(trims(spark, sf_dir), "pos", "left")
    now = F.when(F.expr("pos % 6 = 1"), F.col("t1") + 1).otherwise(F.col("t1"))
    done = progress.exported_by_run(F.col("status") == "ok", [(F.col("t0"), F.col("t0")), (F.col("t1"), now)])
    return rows.select("pos", done.alias("exported"))


@query("SELECT doc_id AS model, sha256(encode(text)) AS sha, true AS complete FROM documents")
def chunked_weights(spark, sf_dir):
    """Files cut into nine chunks that come in another order, put together by index."""
    raw = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("model"), F.encode("text", "UTF-8").alias("raw"))
    # texts of under nine bytes have chunks of no bytes at their end
    size = F.ceil(F.length("raw") / 9)
    order = F.explode(F.array(*map(F.lit, (4, 0, 8, 2, 6, 1, 7, 3, 5))))
    parts = raw.withColumn("chunk", order).withColumn("size", size.cast("int"))
    parts = parts.select("model", "chunk", F.lit(9).alias("chunks"), F.expr("substring(raw, chunk * size + 1, size)").alias("part"))
    return inference.chunked_weights(parts).select("model", F.sha2("content", 256).alias("sha"), "complete")


@query("SELECT DISTINCT event_type || '-' || CAST(user_id % 5 AS VARCHAR) AS key FROM events")
def log_once(spark, sf_dir):
    """Messages that are logged the first time only."""
    return table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", F.expr("user_id % 5")).alias("key")).dropDuplicates(["key"])


@query(_FRAMES + ", s AS (SELECT file_id, count(DISTINCT frame_id % 256) AS signatures FROM frames GROUP BY file_id) SELECT file_id, frame_id, row_number() OVER (PARTITION BY file_id ORDER BY pts_us, frame_id) AS n, signatures FROM frames JOIN s USING (file_id)")
def exported_frames(spark, sf_dir):
    """Every exported frame with its number in its file's order, and how many of the file's signatures differ."""
    return seek.numbered(frames(spark, sf_dir), F.expr("frame_id % 256"))


@query("WITH p AS (SELECT s_suppkey AS k, greatest((i * s_suppkey * 7) % 40, (i * 13 + s_suppkey) % 23, (i * 5) % 17) AS top FROM supplier, range(0, 256) t(i)) SELECT k, count(*) FILTER (WHERE top > 10) AS lit, count(*) FILTER (WHERE top > 10) / 256::DOUBLE AS ratio FROM p GROUP BY k")
def non_black_ratio(spark, sf_dir):
    """Share of 256 pixels of which some channel is above 10."""
    i = F.explode(F.sequence(F.lit(0), F.lit(255)))
    pixels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), i.alias("i"))
    top = F.greatest(F.expr("(i * k * 7) % 40"), F.expr("(i * 13 + k) % 23"), F.expr("(i * 5) % 17"))
    lit = F.count(F.when(top > 10, 1))
    return pixels.groupBy("k").agg(lit.alias("lit"), (lit / 256).alias("ratio"))


@query(_FRAMES + ", a AS (SELECT file_id, frame_id % 9 AS key, max(pts_us) AS last_us, max(frame_id) AS last_frame FROM frames GROUP BY ALL) SELECT file_id, key, last_us FROM a QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY last_us DESC, key) <= 4")
def cache_recency(spark, sf_dir):
    """The four keys of each file that were used last."""
    last = frames(spark, sf_dir).groupBy("file_id", F.expr("frame_id % 9").alias("key")).agg(F.max("pts_us").alias("last_us"))
    order = Window.partitionBy("file_id").orderBy(F.desc("last_us"), "key")
    return last.withColumn("n", F.row_number().over(order)).where("n <= 4").select("file_id", "key", "last_us")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'Ansicht' WHEN 'click' THEN 'Klick' WHEN 'error' THEN 'Fehler' WHEN 'signup' THEN 'signup' ELSE 'purchase' END || ' ' || user_id AS text FROM events")
def translated_labels(spark, sf_dir):
    """Labels in another language, in the first one where there is no translation, with their placeholder filled."""
    first = {"view": "view {n}", "click": "click {n}", "error": "error {n}", "signup": "signup {n}", "purchase": "purchase {n}"}
    other = {"view": "Ansicht {n}", "click": "Klick {n}", "error": "Fehler {n}"}
    look = lambda d: F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("event_type"))
    text = naming.fill(F.coalesce(look(other), look(first)), F.create_map(F.lit("n"), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"))


@query("SELECT event_id, CAST(CAST(floor(value / 60) AS BIGINT) AS VARCHAR) || ':' || printf('%06.3f', value - floor(value / 60) * 60) AS time FROM events")
def time_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", timecode.clock(F.col("value")).alias("time"))


@query("SELECT event_id, strftime(ts, '%H:%M:%S.%g') AS at FROM events")
def log_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", timecode.log_time(F.col("ts").cast("timestamp")).alias("at"))


@query(_FRAMES + ", r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pts_us DESC, frame_id DESC) AS n FROM frames) SELECT file_id, string_agg(frame_id || ' ' || event_type, chr(10) ORDER BY n DESC) AS text FROM r WHERE n <= 1000 GROUP BY file_id")
def log_text(spark, sf_dir):
    """Each log's ring as one text, oldest entry first: at most a thousand lines."""
    return export.joined_log(seek.latest_entries(frames(spark, sf_dir)), F.concat_ws(" ", "frame_id", "event_type"))


@query(_MEDIA + " SELECT pos, CAST(pos % 1001 AS DOUBLE) / 1000 * duration_s AS seconds FROM media")
def scrub_seconds(spark, sf_dir):
    """Where the scrubber's place out of a thousand lies in each item."""
    return media(spark, sf_dir).select("pos", timecode.scrubbed(F.expr("double(pos % 1001)"), F.lit(1000.0), F.col("duration_s")).alias("seconds"))


@query("SELECT event_id, CAST(floor(value / 60) AS BIGINT) AS minutes, CAST(floor((value - floor(value / 60) * 60) * 1000 + 0.5) AS BIGINT) AS millis FROM events")
def time_parts(spark, sf_dir):
    """Whole minutes, and the rest in thousandths of a second, of a time."""
    minutes = F.floor(F.col("value") / 60)
    return table(spark, sf_dir, "events").select("event_id", minutes.cast("bigint").alias("minutes"), F.floor((F.col("value") - minutes * 60) * 1000 + 0.5).cast("bigint").alias("millis"))


@query("SELECT event_id, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS entry FROM events")
def log_records(spark, sf_dir):
    """Log entries as JSON text."""
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("entry"))


@query(_MEDIA + " SELECT pos, CASE WHEN pos % 3 = 0 THEN 'detect_n' WHEN pos % 3 = 1 AND pos % 2 = 0 THEN 'detect_n' ELSE 'detect_x' END AS model FROM media")
def confirmed_model(spark, sf_dir):
    """The stored model: the large one counts only where it is confirmed (here: odd items, and every third)."""
    asked = F.when(F.expr("pos % 3 = 0"), "detect_n").otherwise("detect_x")
    confirmed = F.expr("pos % 2 = 1 or pos % 3 = 2")
    return media(spark, sf_dir).select("pos", m.stored_model(asked, confirmed).alias("model"))
