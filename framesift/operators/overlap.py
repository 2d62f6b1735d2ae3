"""Rectangles of a frame that overlap: pairs, and first-fit batches in the order of detections.

Rectangles are half-open in whole pixels (xi, yi, xe, ye); touching ones don't overlap. One shuffle
by frame brings a frame's rectangles together, which suppression bounds (1,500 of each label); frames
then stream through a task in Arrow batches, compared in NumPy a block of rows at a time. So one
frame is the largest unit, and memory follows a block, not the frame's pairs.

Rectangles with a null corner overlap with nothing and form no pair; in batches they are left out.
Null frame ids are one frame. Rows that repeat a key are rectangles of their own. Empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.operators.nms import LABELS

_SIDES = ("xi", "yi", "xe", "ye")
#: Rectangles that are compared with a frame's others at a time.
BLOCK = 512


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Rows of whole frames, and where each frame starts (and the last ends), from rows sorted by frame."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([*rest, batch]) if rest else batch
        frame = rows.column("frame_id")
        known, value = frame.is_valid().to_numpy(zero_copy_only=False), frame.fill_null(0).to_numpy(zero_copy_only=False)
        new = np.flatnonzero((value[1:] != value[:-1]) | (known[1:] != known[:-1])) + 1
        if len(new):
            yield rows.slice(0, new[-1]), [0, *new.tolist()]
        # the last frame may go on in the next batch
        rest = [rows.slice(new[-1] if len(new) else 0)]
    if rest:
        yield rest[0], [0, rest[0].num_rows]


def _sides(rows: pa.RecordBatch) -> np.ndarray:
    return np.stack([rows.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in _SIDES])


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rectangles a (4, n, 1) and b (4, m) share a pixel; comparisons with NaN are false."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def overlapping(regions: DataFrame) -> DataFrame:
    """Pairs of rectangles of a frame (frame_id, label, anchor, xi, yi, xe, ye) that overlap, the smaller key first (nulls first)."""
    kinds = {c: regions.schema[c].dataType.simpleString() for c in ("frame_id", "label", "anchor")}
    names = ["frame_id", "label_a", "anchor_a", "label_b", "anchor_b"]
    schema = f"frame_id {kinds['frame_id']}, label_a {kinds['label']}, anchor_a {kinds['anchor']}, label_b {kinds['label']}, anchor_b {kinds['anchor']}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _frames(batches):
            sides, found, size = _sides(rows), [], 0
            for start, stop in zip(cuts, cuts[1:]):
                by_left = start + np.argsort(sides[0, start:stop], kind="stable")
                left = sides[0, by_left]
                for at in range(0, len(by_left), BLOCK):
                    own = by_left[at : at + BLOCK]
                    # a rectangle meets none that starts where all of its block have ended
                    others = by_left[at : np.searchsorted(left, sides[2, own].max(), "left")] if len(own) else own
                    i, j = np.nonzero(_meet(sides[:, own, None], sides[:, others]) & (np.arange(len(own))[:, None] < np.arange(len(others))))
                    found.append(np.stack([own[i], others[j]]))
                    size += len(i)
                    if size >= 1 << 16:
                        yield _pairs(rows, found, names)
                        found, size = [], 0
            if size:
                yield _pairs(rows, found, names)

    whole = regions.where("xe > xi and ye > yi").select("frame_id", "label", "anchor", *_SIDES)
    return whole.repartition("frame_id").sortWithinPartitions("frame_id", "label", "anchor").mapInArrow(run, schema)


def _pairs(rows: pa.RecordBatch, found: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    # rows stand in the order of their keys; sorting pairs one by one would cost more than finding them
    one, other = np.concatenate(found, axis=1)
    a, b = pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other))
    columns = [rows.column("frame_id").take(a)] + [rows.column(c).take(x) for x in (a, b) for c in ("label", "anchor")]
    return pa.RecordBatch.from_arrays(columns, names)


def batches(regions: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """frame_id, label, anchor and batch (from 1): each rectangle joins the first batch of its frame in which it overlaps none.

    A frame's rectangles (frame_id, label, anchor, conf, xi, yi, xe, ye) are taken as detections
    come: by label in the order of ``labels`` (others last), then by falling confidence (null and
    NaN last); ties go to the smaller anchor.
    """
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("label"))
    rank = F.when(place > 0, place).otherwise(len(labels) + 1)
    sure = F.when(~F.isnan("conf"), F.col("conf"))
    kinds = ", ".join(f"{c} {regions.schema[c].dataType.simpleString()}" for c in ("frame_id", "label", "anchor"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _frames(parts):
            sides = _sides(rows)
            number = np.zeros(rows.num_rows, np.int64)
            for start, stop in zip(cuts, cuts[1:]):
                _first_fit(sides[:, start:stop], number[start:stop])
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("frame_id", "label", "anchor")), pa.array(number)], ["frame_id", "label", "anchor", "batch"])

    order = regions.dropna(subset=list(_SIDES)).withColumns({"_rank": rank, "_conf": sure})
    order = order.repartition("frame_id").sortWithinPartitions("frame_id", "_rank", F.desc_nulls_last("_conf"), "anchor", "label")
    return order.select("frame_id", "label", "anchor", *_SIDES).mapInArrow(run, f"{kinds}, batch bigint")


def _first_fit(sides: np.ndarray, number: np.ndarray) -> None:
    """Fill in the batch of each rectangle, in order; a block's overlaps with all before it are compared at once."""
    n = sides.shape[1]
    for start in range(0, n, BLOCK):
        stop = min(n, start + BLOCK)
        met = _meet(sides[:, start:stop, None], sides[:, :stop])
        for i in range(start, stop):
            taken = np.zeros(i + 2, bool)
            taken[number[:i][met[i - start, :i]]] = True
            taken[0] = True
            number[i] = taken.argmin()
