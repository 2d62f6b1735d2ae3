"""Pixels of frames: redaction of boxes, masks, model input, sample depth. One frame to a row.

Frames are read one at a time from an Arrow batch and handed on in groups of a few MB, so that at
4K no batch stands twice in memory; how many frames Spark puts into a batch is the session's
``spark.sql.execution.arrow.maxRecordsPerBatch``. Null pixels, and pixels whose number doesn't fit
the size, stay as they are in ``redact`` and give null elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions import geometry as g

#: Value that fills the model input around a picture (fixed value).
GREY = 114
#: Bytes of pixels that are handed on at a time.
GROUP_BYTES = 1 << 23


@dataclass(frozen=True)
class Box:
    """A clipped box: place, size, corner radii (tl, tr, br, bl) and snapped sides (l, t, r, b)."""

    x: float
    y: float
    w: float
    h: float
    corners: tuple[float, float, float, float] = (0, 0, 0, 0)
    snapped: tuple[bool, bool, bool, bool] = (False, False, False, False)


def distance(px: np.ndarray, py: np.ndarray, x: float, y: float, w: float, h: float, corners: tuple) -> np.ndarray:
    """Signed distance of points to a rounded box."""
    tl, tr, br, bl = corners
    cx, cy = x + w / 2, y + h / 2
    r = np.where(px < cx, np.where(py < cy, tl, bl), np.where(py < cy, tr, br))
    qx, qy = np.abs(px - cx) - w / 2 + r, np.abs(py - cy) - h / 2 + r
    return np.hypot(np.maximum(qx, 0), np.maximum(qy, 0)) + np.minimum(np.maximum(qx, qy), 0) - r


def mask(width: int, height: int, feather: float, ox: float, oy: float, box: Box) -> np.ndarray:
    """Share of blur of each pixel: 1 inside the box, down to 0 over the feather; snapped sides have no feather."""
    px, py = np.meshgrid(np.arange(width, dtype=float), np.arange(height, dtype=float))
    left, top, right, bottom = box.snapped
    if left:
        px = np.maximum(px, ox)
    if right:
        px = np.minimum(px, ox + box.w)
    if top:
        py = np.maximum(py, oy)
    if bottom:
        py = np.minimum(py, oy + box.h)
    return np.clip(1 - distance(px, py, ox, oy, box.w, box.h, box.corners) / feather, 0, 1)


def stack_blur(pixels: np.ndarray, radius: int) -> np.ndarray:
    """Blur of an image (rows x columns x channels) by a triangle of the given radius along both axes, edges repeated.

    A triangle is a box over a box: two running sums for each axis, whatever the radius.
    """
    out, side = pixels.astype(np.int64), radius + 1
    for axis in (1, 0):
        out = np.pad(out, [(radius, radius) if a == axis else (0, 0) for a in range(3)], mode="edge")
        for _ in range(2):
            sums = np.cumsum(np.pad(out, [(1, 0) if a == axis else (0, 0) for a in range(3)]), axis=axis)
            n = sums.shape[axis]
            out = np.take(sums, np.arange(side, n), axis=axis) - np.take(sums, np.arange(n - side), axis=axis)
        out //= side * side
    return out.astype(np.uint8)


def half_up(x: float) -> int:
    return int(np.floor(x + 0.5))


def fill(pixels: np.ndarray, box: Box, colour: tuple[int, int, int]) -> None:
    """Paint the rounded box."""
    height, width = pixels.shape[:2]
    x0, y0 = max(0, int(np.floor(box.x)) - 1), max(0, int(np.floor(box.y)) - 1)
    x1, y1 = min(width, int(np.ceil(box.x + box.w)) + 1), min(height, int(np.ceil(box.y + box.h)) + 1)
    if x0 >= x1 or y0 >= y1:
        return
    px, py = np.meshgrid(np.arange(x0, x1) + 0.5, np.arange(y0, y1) + 0.5)
    pixels[y0:y1, x0:x1, :3][distance(px, py, box.x, box.y, box.w, box.h, box.corners) <= 0] = colour


def pixelate(pixels: np.ndarray, box: Box) -> None:
    """Replace the box by blocks of mean colour; corners are square."""
    height, width = pixels.shape[:2]
    x, y, w, h = map(half_up, (box.x, box.y, box.w, box.h))
    if w <= 0 or h <= 0:
        return
    block = max(8, min(60, half_up(min(w, h) / 8 * max(1.0, width / 1280))))
    cols, rows = -(-w // block), -(-h // block)
    x0, y0, x1, y1 = max(0, x), max(0, y), min(width, x + w), min(height, y + h)
    for j in range(rows):
        for i in range(cols):
            a, b = max(x0, x + i * w // cols), min(x1, x + (i + 1) * w // cols)
            c, d = max(y0, y + j * h // rows), min(y1, y + (j + 1) * h // rows)
            if a < b and c < d:
                part = pixels[c:d, a:b, :3]
                part[:] = np.floor(part.reshape(-1, 3).mean(axis=0) + 0.5).astype(np.uint8)


def blur(pixels: np.ndarray, box: Box) -> None:
    """Blend a blurred copy in by the box's feathered mask."""
    height, width = pixels.shape[:2]
    feather = half_up(max(3.0, max(box.w, box.h) / 12))
    xi, yi = max(0, int(np.floor(box.x - feather * 2))), max(0, int(np.floor(box.y - feather * 2)))
    xe, ye = min(width, int(np.ceil(box.x + box.w + feather * 2))), min(height, int(np.ceil(box.y + box.h + feather * 2)))
    wi, hi = xe - xi, ye - yi
    wi, hi = min(wi + 5 - wi % 5, width - xi), min(hi + 5 - hi % 5, height - yi)
    if wi <= 0 or hi <= 0:
        return
    strength = max(10, min(50, half_up(wi * hi / 100)))
    plain = pixels[yi : yi + hi, xi : xi + wi, :3].astype(float)
    soft = stack_blur(plain, strength).astype(float)
    share = mask(wi, hi, feather, box.x - xi, box.y - yi, box)[:, :, None]
    pixels[yi : yi + hi, xi : xi + wi, :3] = np.clip(np.rint(soft * share + plain * (1 - share)), 0, 255).astype(np.uint8)


def _clipped(detection: dict, width: int, height: int) -> Box:
    x, y, w, h = (detection[c] for c in "xywh")
    r = half_up(min(w, h) / 2 * g.CORNER.get(detection["label"], 0))
    near_x, near_y = width * g.EDGE, height * g.EDGE
    left, top, right, bottom = x < near_x, y < near_y, x + w > width - near_x, y + h > height - near_y
    bx, by = (0 if left else x), (0 if top else y)
    bw = width - bx if right else w + x if left else w
    bh = height - by if bottom else h + y if top else h
    corner = lambda a, b: 0 if a or b else r
    return Box(bx, by, bw, bh, (corner(left, top), corner(right, top), corner(right, bottom), corner(left, bottom)), (left, top, right, bottom))


def redact(frames: DataFrame, mode: str = "blur", colour: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """``frames`` (frame_id, width, height, rgba, detections, ...) with rgba redacted: solid, pixelate or blur.

    Detections apply in their order. Redaction depends on the frame's own row alone; frames with a
    pixel count that doesn't fit, with a null size or without detections come back as they are. A
    detection that is null or has a null or NaN coordinate has no place and is passed over; one
    with a label other than plate and person, or none, has square corners.
    """
    paint = {"solid": lambda pixels, box: fill(pixels, box, colour), "pixelate": pixelate, "blur": blur}[mode]

    def redacted(raw: bytes | None, w: int | None, h: int | None, detections: list | None) -> bytes | None:
        placed = [d for d in detections or [] if d and all(d[c] is not None and d[c] == d[c] for c in "xywh")]
        if not raw or not placed or w is None or h is None or len(raw) != w * h * 4:
            return raw
        pixels = np.frombuffer(raw, np.uint8).reshape(h, w, 4).copy()
        for d in placed:
            paint(pixels, _clipped(d, w, h))
        return pixels.tobytes()

    def run(batches):
        for batch in batches:
            names, place = batch.schema.names, batch.schema.get_field_index("rgba")
            columns = [batch.column(c) for c in ("rgba", "width", "height", "detections")]
            start, size, out = 0, 0, []
            for i in range(batch.num_rows):
                out.append(redacted(*(c[i].as_py() for c in columns)))
                size += len(out[-1] or b"")
                if size >= GROUP_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(start, len(out))
                    pixels = pa.array(out, batch.schema.field("rgba").type)
                    yield pa.RecordBatch.from_arrays([pixels if k == place else part.column(k) for k in range(len(names))], schema=batch.schema)
                    start, size, out = i + 1, 0, []

    return frames.mapInArrow(run, frames.schema)


def _each(kind: pa.DataType, make, *columns: pa.Array) -> pa.Array:
    """``make`` of each row's values, one row as Python values at a time; null where it gives None."""
    return pa.array((make(*(c[i].as_py() for c in columns)) for i in range(len(columns[0]))), kind)


def tensor(rgba: Column, width: Column, height: Column) -> Column:
    """Planar float32 RGB in 0 to 1, as little-endian bytes, of an RGBA picture; null where the pixels don't fit the size."""

    def planes(raw: bytes | None, w: int | None, h: int | None) -> bytes | None:
        if raw is None or w is None or h is None or len(raw) != w * h * 4:
            return None
        return (np.frombuffer(raw, np.uint8).reshape(h, w, 4)[:, :, :3].transpose(2, 0, 1).astype("<f4") / np.float32(255)).tobytes()

    @F.arrow_udf("binary")
    def build(raw: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        return _each(pa.binary(), planes, raw, w, h)

    return build(rgba, width, height)


def samples_of_one(tensor: Column) -> Column:
    """Array of how many samples of each plane of a planar float32 tensor are 1, in the order of the planes; null where its bytes aren't three planes."""

    def ones(raw: bytes | None) -> list | None:
        return None if raw is None or len(raw) % 12 else (np.frombuffer(raw, "<f4").reshape(3, -1) == 1).sum(axis=1).tolist()

    @F.arrow_udf("array<bigint>")
    def count(tensors: pa.Array) -> pa.Array:
        return _each(pa.list_(pa.int64()), ones, tensors)

    return count(tensor)


def channel_sums(rgba: Column) -> Column:
    """Struct of the sums of red, green and blue over a picture's pixels, of red times the pixel's number, and of pixels of which some channel is above 10."""

    def sums(raw: bytes | None) -> dict | None:
        if raw is None:
            return None
        pixels = np.frombuffer(raw, np.uint8)[: len(raw) // 4 * 4].reshape(-1, 4)[:, :3].astype(np.int64)
        red, green, blue = pixels.sum(axis=0).tolist()
        return {"red": red, "green": green, "blue": blue, "red_moment": int(pixels[:, 0] @ np.arange(len(pixels))), "lit": int((pixels.max(axis=1) > 10).sum()) if len(pixels) else 0}

    names = ("red", "green", "blue", "red_moment", "lit")

    @F.arrow_udf(", ".join(f"{n} bigint" for n in names))
    def run(raw: pa.Array) -> pa.Array:
        return _each(pa.struct([(n, pa.int64()) for n in names]), sums, raw)

    return run(rgba)


def area_scaled(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """A picture (rows, columns, channels) scaled so that each sample is the mean of the area it covers, parts of pixels by their share."""
    for axis, size in ((0, height), (1, width)):
        old = pixels.shape[axis]
        edges = np.arange(size + 1) * (old / size)
        whole = np.minimum(edges.astype(np.int64), old)
        share = (edges - whole).reshape([-1 if k == axis else 1 for k in range(pixels.ndim)])
        # sums up to an edge: of all pixels before it, and of the share of the one that it cuts
        sums = np.cumsum(pixels, axis=axis, dtype=np.float64)
        sums = np.concatenate([np.zeros_like(sums.take([0], axis)), sums], axis=axis).take(whole, axis)
        sums += share * pixels.take(np.minimum(whole, old - 1), axis)
        pixels = np.diff(sums, axis=axis) * (size / old)
    return pixels


def snapshot(pixels: np.ndarray, side: int = g.SIDE) -> np.ndarray:
    """A picture scaled into the model's square by area, each channel by itself, grey around it; .5 rounds up."""
    h, w = pixels.shape[:2]
    scale = min(side / w, side / h)
    sw, sh = max(1, half_up(w * scale)), max(1, half_up(h * scale))
    px, py = (side - sw) // 2, (side - sh) // 2
    out = np.full((side, side, pixels.shape[2]), GREY, np.uint8)
    for k in range(pixels.shape[2]):
        # sums of whole numbers leave errors far below this
        out[py : py + sh, px : px + sw, k] = np.floor(area_scaled(pixels[:, :, k], sw, sh) + (0.5 + 1e-9))
    return out


def to_8_bit(planes: Column, width: Column, height: Column, layout: Column) -> Column:
    """8-bit planar 4:2:0 bytes from 10-bit little-endian ones whose planes lie at (offset, stride); odd sizes lose a chroma column; null where a plane is cut off."""

    def narrow(raw: bytes | None, w: int | None, h: int | None, lay: list | None) -> bytes | None:
        if raw is None or w is None or h is None or not lay or len(lay) < 3:
            return None
        view, parts = np.frombuffer(raw[: len(raw) // 2 * 2], "<u2"), []
        for (pw, ph), p in zip(((w, h), (w // 2, h // 2), (w // 2, h // 2)), lay):
            rows = [view[p["offset"] // 2 + k * (p["stride"] // 2) :][:pw] for k in range(ph)]
            if any(len(r) != pw for r in rows):
                return None
            parts += [(r >> 2).astype(np.uint8).tobytes() for r in rows]
        return b"".join(parts)

    @F.arrow_udf("binary")
    def convert(raw: pa.Array, w: pa.Array, h: pa.Array, at: pa.Array) -> pa.Array:
        return _each(pa.binary(), narrow, raw, w, h, at)

    return convert(planes, width, height, layout)
