"""Frames of 10-bit planes to 8-bit RGBA: range, matrix, chroma upsampling, and tone mapping of HDR frames.

Planes are luma, then both chroma planes at half the size (rounded up), as little-endian 16-bit
words. Chroma lies level with every second luma column and between two rows; samples between are
mixed from their neighbours. A frame is converted in bands of rows and handed on in groups of a
few MB. Planes that are null or don't fit a null or other size give null pixels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from framesift.functions import media as m
from framesift.functions import tonemap as t
from framesift.operators.redact import GROUP_BYTES

#: Shares of red and blue in luma, by matrix (fixed values of BT.2020 and BT.709).
SHARES = {"bt2020": (0.2627, 0.0593), "bt709": (0.2126, 0.0722)}
#: Rows that are converted at a time.
BAND = 64


def upsampled(plane: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """A chroma plane at luma rows and all luma columns."""
    y = np.clip((rows - 0.5) / 2, 0, plane.shape[0] - 1)
    x = np.clip(np.arange(width) / 2, 0, plane.shape[1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, plane.shape[0] - 1), np.minimum(x0 + 1, plane.shape[1] - 1)
    lines = plane[y0] + (plane[y1] - plane[y0]) * (y - y0)[:, None]
    return lines[:, x0] + (lines[:, x1] - lines[:, x0]) * (x - x0)


def linear_hlg(rgb: np.ndarray) -> np.ndarray:
    light = np.where(rgb <= 0.5, rgb * rgb / 3, (np.exp((rgb - t.HLG_C) / t.HLG_A) + t.HLG_B) / 12)
    luma = light @ np.array(t.LUMA)
    return light * (np.maximum(luma, 1e-6) ** 0.2)[..., None]


def linear_pq(rgb: np.ndarray) -> np.ndarray:
    p = rgb ** (1 / t.PQ_M2)
    return np.minimum((np.maximum(p - t.PQ_C1, 0) / (t.PQ_C2 - t.PQ_C3 * p)) ** (1 / t.PQ_M1) * t.WHITE, 1)


def srgb(light: np.ndarray) -> np.ndarray:
    x = np.clip(light @ np.array(t.TO_SRGB).T, 0, 1)
    return np.where(x <= 0.0031308, 12.92 * x, 1.055 * x ** (1 / 2.4) - 0.055)


def to_rgba(raw: bytes | None, width: int | None, height: int | None, matrix: str, full_range: bool, transfer: str | None) -> bytes | None:
    """A frame's pixels; ``transfer`` is hlg, pq, or None for samples that are shown as they are."""
    if raw is None or not width or not height or width < 0 or height < 0:
        return None
    small = (-(-height // 2), -(-width // 2))
    n, k = width * height, small[0] * small[1]
    if len(raw) != 2 * (n + 2 * k):
        return None
    words = np.frombuffer(raw, "<u2") & 1023
    luma, blue, red = words[:n].reshape(height, width), words[n : n + k].reshape(small), words[n + k :].reshape(small)
    low, step, chroma = (0, 1023, 1023) if full_range else (64, 876, 896)
    kr, kb = SHARES[matrix]
    out = np.full((height, width, 4), 255, np.uint8)
    cb, cr = blue.astype(float), red.astype(float)
    for top in range(0, height, BAND):
        rows = np.arange(top, min(top + BAND, height))
        y = (luma[rows].astype(float) - low) / step
        r = y + 2 * (1 - kr) * ((upsampled(cr, rows, width) - 512) / chroma)
        b = y + 2 * (1 - kb) * ((upsampled(cb, rows, width) - 512) / chroma)
        g = (y - kr * r - kb * b) / (1 - kr - kb)
        rgb = np.clip(np.stack([r, g, b], axis=2), 0, 1)
        if transfer is not None:
            rgb = srgb((linear_pq if transfer == "pq" else linear_hlg)(rgb))
        out[rows, :, :3] = np.floor(255 * rgb + 0.5)
    return out.tobytes()


def rendered(frames: DataFrame, tone_mapping: Column | None = None) -> DataFrame:
    """``frames`` (width, height, planes, primaries, transfer, full_range, ...) with rgba in the place of planes, and ``effective``.

    HDR frames are tone-mapped by their effective transfer (pq, else hlg), others are converted
    alone; so are all frames where ``tone_mapping`` isn't true (None: it is). ``effective`` is null
    for those. A null range counts as limited.
    """
    hdr = m.is_hdr(F.col("primaries"), F.col("transfer")) & (F.lit(True) if tone_mapping is None else F.coalesce(tone_mapping, F.lit(False)))
    rows = frames.withColumn("effective", F.when(hdr, m.effective_transfer(F.col("transfer"))))
    fields = [StructField("rgba", BinaryType()) if f.name == "planes" else f for f in rows.schema.fields]
    at = [f.name for f in fields].index("rgba")

    def run(batches):
        for batch in batches:
            used = [batch.column(c) for c in ("planes", "width", "height", "primaries", "full_range", "effective")]
            start, size, out = 0, 0, []
            for i in range(batch.num_rows):
                planes, width, height, primaries, full, effective = (c[i].as_py() for c in used)
                matrix = "bt2020" if primaries == "bt2020" or effective else "bt709"
                out.append(to_rgba(planes, width, height, matrix, bool(full), effective))
                size += len(out[-1] or b"")
                if size >= GROUP_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(start, len(out)).columns
                    part[at] = pa.array(out, pa.binary())
                    yield pa.RecordBatch.from_arrays(part, names=[f.name for f in fields])
                    start, size, out = i + 1, 0, []

    return rows.mapInArrow(run, StructType(fields))
