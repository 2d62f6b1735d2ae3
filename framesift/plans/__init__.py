"""Registered queries over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def all_queries():
    """Queries and SQL oracles of all plan modules."""
    from framesift.plans import catalog, detections, exports, files, pixels, registry, state, streams  # noqa: F401

    return registry.QUERIES, registry.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From head rows to filtered, expanded boxes on the picture, and their number in each frame."""
    from framesift.functions import geometry as g
    from framesift.operators import nms
    from framesift.sources.tables import raw_boxes

    found = nms.suppress(nms.class_candidates(raw_boxes(spark, sf_dir)))
    fit = g.letterbox(F.lit(1429.0), F.lit(497.0))
    box = g.to_picture({c: F.col(c) for c in ("cx", "cy", "w", "h")}, fit["scale"], fit["pad_x"], fit["pad_y"])
    placed = found.select("frame_id", "label", "conf", *(v.cast("double").alias(k) for k, v in box.items()))
    kept = nms.filter_detections(placed, 0.05, nms.LABELS)
    grown = g.expand({c: F.col(c) for c in ("x", "y", "w", "h")}, 0.2, F.lit(1429.0), F.lit(497.0))
    boxes = kept.select("frame_id", "label", "conf", *(v.alias(k) for k, v in grown.items()))
    return boxes.groupBy("frame_id", "label").agg(F.count("*").alias("n"), F.max("conf").alias("best"), F.sum(F.round(F.col("w") * F.col("h")).cast("bigint")).alias("area"))
