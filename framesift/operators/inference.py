"""Detector inference as a plug-in: frames in, head rows out, one session for each worker process.

Weights aren't part of this package. A model is any callable from a float32 input (1, 3, side,
side) to a head (1, rows, 7) of centre x and y, width, height, objectness and two class scores.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.functions import geometry as g
from framesift.operators.redact import snapshot

Model = Callable[[np.ndarray], np.ndarray]

#: Providers that a session tries, best first (fixed values).
PROVIDERS = ("webgpu", "wasm")
SCHEMA = "frame_id bigint, anchor bigint, cx double, cy double, w double, h double, obj double, c0 double, c1 double"


@functools.lru_cache(maxsize=1)
def _session(path: str):
    """A worker process keeps its last session, so tasks that follow on it don't load the weights again."""
    import onnxruntime

    return onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])


def onnx_model(path: str) -> Model:
    """A model from a weights file on the worker (SparkContext.addFile), where onnxruntime is installed."""
    session = _session(path)
    name = session.get_inputs()[0].name
    return lambda tensor: session.run(None, {name: tensor})[0]


def cell_means(cell: int) -> Model:
    """A stand-in model: a head row for each cell of a grid over the input, scored by its mean red, green and blue."""

    def run(tensor: np.ndarray) -> np.ndarray:
        planes = tensor[0]
        n = planes.shape[1] // cell
        means = planes[:, : n * cell, : n * cell].reshape(3, n, cell, n, cell).mean(axis=(2, 4), dtype=np.float64).reshape(3, -1)
        y, x = np.divmod(np.arange(n * n), n)
        return np.stack([x * cell + cell / 2, y * cell + cell / 2, np.full(n * n, cell), np.full(n * n, cell), *means], axis=1)[None]

    return run


def infer(frames: DataFrame, make_model: Callable[[], Model], side: int = g.SIDE) -> DataFrame:
    """Head rows of each frame (frame_id, width, height, rgba), in model space.

    Frames are letterboxed by area and go through the model one by one, a few frames' rows are
    handed on at a time. Frames whose pixels are null or don't fit their size have no rows;
    repeated frames have theirs each; a null frame_id stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            for i, (width, height) in enumerate(zip(batch.column("width").to_pylist(), batch.column("height").to_pylist())):
                raw = batch.column("rgba")[i].as_py()
                if raw is None or not width or not height or len(raw) != width * height * 4:
                    continue
                model = model or make_model()
                pixels = snapshot(np.frombuffer(raw, np.uint8).reshape(height, width, 4)[:, :, :3], side)
                head = np.asarray(model(pixels.transpose(2, 0, 1)[None].astype(np.float32) / np.float32(255)))[0].astype(np.float64)
                frame = batch.column("frame_id").slice(i, 1).take(pa.array(np.zeros(len(head), np.int64)))
                yield pa.RecordBatch.from_arrays([frame, pa.array(np.arange(1, len(head) + 1)), *map(pa.array, np.ascontiguousarray(head.T))], SCHEMA_NAMES)

    return frames.select(F.col("frame_id").cast("bigint").alias("frame_id"), "width", "height", "rgba").mapInArrow(run, SCHEMA)


SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def chunked_weights(chunks: DataFrame) -> DataFrame:
    """model, content and complete of weights that come in numbered chunks (model, chunk, chunks, part), whatever their order."""
    lists = chunks.groupBy("model", "chunks").agg(F.array_sort(F.collect_list(F.struct("chunk", "part"))).alias("s"))
    numbers = F.transform("s", lambda x: x["chunk"])
    content = F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["part"]))
    return lists.select("model", content.alias("content"), (numbers == F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))).alias("complete"))
