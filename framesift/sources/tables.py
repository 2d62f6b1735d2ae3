"""Input tables, and the media-like views that fixed arithmetic derives from them.

The tables hold no media, so boxes, frames, files, trims and tags are computed from their columns;
the SQL beside each view computes the same in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector head rows: frame_id, anchor, centre box, objectness, and a score for each of two classes."""
    cents = lambda c: F.round(F.col(c) * 100).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 16").alias("frame_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("int").alias("q"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("ep"),
        cents("l_discount").alias("ds"), cents("l_tax").alias("tx"),
    )
    order = Window.partitionBy("frame_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ep", "q", "ds", "tx")
    return rows.select(
        "frame_id",
        F.row_number().over(order).cast("bigint").alias("anchor"),
        F.expr("double(40 + (ep % 12) * 20)").alias("cx"),
        F.expr("double(40 + ((l_partkey * 7 + l_suppkey) % 10) * 20)").alias("cy"),
        F.expr("double(20 + q)").alias("w"),
        F.expr("double(20 + (ds * 3 + tx))").alias("h"),
        F.expr("(1 + (ep * 31 + q * 17) % 9999) / 10000.0D").alias("obj"),
        F.expr("((l_suppkey * 13 + q) % 101) / 100.0D").alias("c0"),
        F.expr("((l_partkey * 11 + q) % 101) / 100.0D").alias("c1"),
    )


RAW = """
fx AS (SELECT l_orderkey // 16 AS frame_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) AS q,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS ep, CAST(round(l_discount * 100) AS INT) AS ds, CAST(round(l_tax * 100) AS INT) AS tx FROM lineitem),
raw AS (SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, ep, q, ds, tx) AS anchor,
         CAST(40 + (ep % 12) * 20 AS DOUBLE) AS cx, CAST(40 + ((l_partkey * 7 + l_suppkey) % 10) * 20 AS DOUBLE) AS cy,
         CAST(20 + q AS DOUBLE) AS w, CAST(20 + (ds * 3 + tx) AS DOUBLE) AS h,
         CAST(1 + (ep * 31 + q * 17) % 9999 AS DOUBLE) / 10000::DOUBLE AS obj,
         CAST((l_suppkey * 13 + q) % 101 AS DOUBLE) / 100::DOUBLE AS c0, CAST((l_partkey * 11 + q) % 101 AS DOUBLE) / 100::DOUBLE AS c1 FROM fx)
"""


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows: pos, name, size, is_video, mime, duration_s, width, height, captured_at; names repeat."""
    orders = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return orders.select(
        F.col("o_orderkey").alias("pos"),
        F.expr("concat('clip_', string(o_orderkey % 5000), if(o_orderkey % 3 <> 0, '.mp4', '.jpg'))").alias("name"),
        F.expr("1 + o_custkey % 3").alias("size"),
        F.expr("o_orderkey % 3 <> 0").alias("is_video"),
        F.expr("case when o_orderkey % 7 = 0 then 'text/plain' when o_orderkey % 3 <> 0 then 'video/mp4' else 'image/jpeg' end").alias("mime"),
        F.expr("(cents % 600000) / 1000.0D").alias("duration_s"),
        F.expr("case o_orderkey % 4 when 0 then 1280 when 1 then 1920 when 2 then 3840 else 1429 end").cast("bigint").alias("width"),
        F.expr("case o_orderkey % 4 when 0 then 720 when 1 then 1080 when 2 then 2160 else 497 end").cast("bigint").alias("height"),
        F.col("o_orderdate").alias("captured_at"),
        "cents",
    )


MEDIA = """
media AS (SELECT o_orderkey AS pos, 'clip_' || (o_orderkey % 5000) || CASE WHEN o_orderkey % 3 <> 0 THEN '.mp4' ELSE '.jpg' END AS name,
  1 + o_custkey % 3 AS size, o_orderkey % 3 <> 0 AS is_video,
  CASE WHEN o_orderkey % 7 = 0 THEN 'text/plain' WHEN o_orderkey % 3 <> 0 THEN 'video/mp4' ELSE 'image/jpeg' END AS mime,
  CAST(cents % 600000 AS DOUBLE) / 1000::DOUBLE AS duration_s,
  CAST(CASE o_orderkey % 4 WHEN 0 THEN 1280 WHEN 1 THEN 1920 WHEN 2 THEN 3840 ELSE 1429 END AS BIGINT) AS width,
  CAST(CASE o_orderkey % 4 WHEN 0 THEN 720 WHEN 1 THEN 1080 WHEN 2 THEN 2160 ELSE 497 END AS BIGINT) AS height, o_orderdate AS captured_at, cents
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders))
"""


def trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved trims by pos: start and end in seconds, some inverted, negative or beyond the end."""
    return media(spark, sf_dir).where("pos % 5 <> 0").select("pos", F.expr("double(pos * 37 % 700) - 50").alias("t0"), F.expr("double(pos * 53 % 700)").alias("t1"))


TRIMS = "trims AS (SELECT pos, CAST(pos * 37 % 700 AS DOUBLE) - 50 AS t0, CAST(pos * 53 % 700 AS DOUBLE) AS t1 FROM media WHERE pos % 5 <> 0)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video frames: file_id, frame_id and pts_us, absolute microseconds."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("frame_id"), F.unix_micros(ts).alias("pts_us"), "event_type", "value")


FRAMES = "frames AS (SELECT user_id AS file_id, event_id AS frame_id, epoch_us(ts) AS pts_us, event_type, value FROM events)"


def inferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference log: seq, model, ms, pts_us."""
    model = F.when(F.col("event_type").isin("view", "click"), "detect_n").otherwise("detect_x")
    return frames(spark, sf_dir).select(F.col("frame_id").alias("seq"), model.alias("model"), F.col("value").alias("ms"), "pts_us", "file_id")


INFERENCES = FRAMES + ", inferences AS (SELECT frame_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'detect_n' ELSE 'detect_x' END AS model, value AS ms, pts_us, file_id FROM frames)"
