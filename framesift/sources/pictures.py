"""Synthetic pictures from table rows: JPEG bytes with EXIF, and checkerboards with detections. Also real picture files."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.sources.tables import table


def picture_files(spark: SparkSession, path: str) -> DataFrame:
    """Picture files under a folder as path, modificationTime, length and content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def directory(order: str, at: int, fields: list[tuple[int, int, int, bytes]]) -> bytes:
    """A TIFF directory at an offset, with the values that don't fit in it after it."""
    body, tail = struct.pack(order + "H", len(fields)), b""
    for tag, kind, count, raw in fields:
        place = struct.pack(order + "I", at + 6 + 12 * len(fields) + len(tail)) if len(raw) > 4 else raw.ljust(4, b"\0")
        tail += raw if len(raw) > 4 else b""
        body += struct.pack(order + "HHI", tag, kind, count) + place
    return body + struct.pack(order + "I", 0) + tail


def exif_jpeg(key: int, taken: str) -> bytes:
    """A JPEG's segments with a date, a zone and, for even keys, a place; byte order by key."""
    order = "<" if key % 3 else ">"
    exif = [(0x9003, 2, 20, taken.encode() + b"\0"), (0x9011, 2, 7, b"+01:00\0")]
    rational = lambda d: struct.pack(order + "6I", d, 1, key % 60, 1, key % 6000, 100)
    gps = [(1, 2, 2, b"S\0" if key % 4 == 0 else b"N\0"), (2, 5, 3, rational(key % 90)), (3, 2, 2, b"E\0"), (4, 5, 3, rational(key % 180))]
    top = 2 + 12 * (1 + (key % 2 == 0)) + 4
    exif_at = 8 + top
    exif_part = directory(order, exif_at, exif)
    gps_at = exif_at + len(exif_part)
    pointers = [(0x8769, 4, 1, struct.pack(order + "I", exif_at))] + [(0x8825, 4, 1, struct.pack(order + "I", gps_at))] * (key % 2 == 0)
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + directory(order, 8, pointers) + exif_part + (directory(order, gps_at, gps) if key % 2 == 0 else b"")
    scan = segment(0xDA, b"\x01") + bytes(range(key % 50)) + b"\xff\xd9"
    return b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + tiff) + segment(0xDB, bytes(64)) + scan


def jpegs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and jpeg, one for each order."""

    @F.arrow_udf("binary")
    def build(keys: pa.Array, taken: pa.Array) -> pa.Array:
        return pa.array([exif_jpeg(k, t) for k, t in zip(keys.to_pylist(), taken.to_pylist())], pa.binary())

    taken = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy:MM:dd HH:mm:ss")
    return table(spark, sf_dir, "orders").select("o_orderkey", build("o_orderkey", taken).alias("jpeg"))


def checkerboard(width: int, height: int, cell: int = 8) -> np.ndarray:
    """Red and blue cells."""
    y, x = np.mgrid[:height, :width] // cell
    red = (x + y) % 2 == 0
    return np.stack([np.where(red, 255, 0), np.zeros_like(x), np.where(red, 0, 255), np.full_like(x, 255)], axis=2).astype(np.uint8)


#: Frames in a partition of checkerboards, about 10 MB of pixels: an Arrow batch holds up to a partition's rows, so that bounds what a Python worker is given.
FRAMES = 128


def checkerboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 160 x 120 checkerboard for each supplier, with two detections placed by its key. Keys are dealt over partitions of about ``FRAMES`` before pixels are made."""
    keys = table(spark, sf_dir, "supplier").select("s_suppkey")
    keys = keys.repartition(max(1, -(-keys.count() // FRAMES)))

    @F.arrow_udf("binary")
    def build(keys: pa.Array) -> pa.Array:
        return pa.array([checkerboard(160, 120, 4 + k % 5).tobytes() for k in keys.to_pylist()], pa.binary())

    box = lambda label, x, y, w, h: F.struct(F.lit(label).alias("label"), F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"), F.expr(w).cast("double").alias("w"), F.expr(h).cast("double").alias("h"))
    found = F.array(box("plate", "s_suppkey % 60", "s_suppkey * 3 % 50", "30 + s_suppkey % 20", "20"), box("person", "90", "s_suppkey * 7 % 40", "25", "60 + s_suppkey % 30"))
    return keys.select(F.col("s_suppkey").alias("frame_id"), F.lit(160).alias("width"), F.lit(120).alias("height"), build("s_suppkey").alias("rgba"), found.alias("detections"))
