"""The inference plug-in with a stand-in model, and the export helpers."""

import numpy as np
from pyspark.sql import functions as F

from framesift.operators import export, inference, nms, redact
from framesift.sources.pictures import checkerboard


def test_infer_and_suppress(spark):
    def make():
        # one box in the middle of the input, its score the mean of the red plane
        return lambda t: np.array([[[32, 32, 10, 12, 0.9, t[0, 0].mean(), 0.0], [33, 32, 10, 12, 0.8, t[0, 0].mean(), 0.0]]], np.float32)

    rows = [(1, 64, 64, checkerboard(64, 64).tobytes()), (2, 64, 64, None), (3, 8, 8, b"short")]
    frames = spark.createDataFrame(rows, "frame_id bigint, width int, height int, rgba binary")
    head = inference.infer(frames, make, side=64)
    assert [(r.frame_id, r.anchor) for r in head.orderBy("anchor").collect()] == [(1, 1), (1, 2)]
    assert [(r.label, r.anchor) for r in nms.suppress(nms.class_candidates(head)).collect()] == [("plate", 1)]


def test_chunks_by_index(spark):
    rows = [("a", 1, 2, b"cd"), ("a", 0, 2, b"ab"), ("b", 0, 2, b"x")]
    found = {r.model: (bytes(r.content), r.complete) for r in inference.chunked_weights(spark.createDataFrame(rows, "model string, chunk int, chunks int, part binary")).collect()}
    assert found == {"a": (b"abcd", True), "b": (b"x", False)}


def test_write_files(spark, tmp_path):
    files = spark.createDataFrame([("a.jpg", b"1", 1), ("a.jpg", b"2", 2), ("b.jpg", b"3", 1)], "name string, content binary, exported_at int")
    export.write_files(files, f"file://{tmp_path}/out")
    assert {r.name: bytes(r.content) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {"a.jpg": b"2", "b.jpg": b"3"}


def test_batch_keeps_failures_apart_and_stops_at_the_first_abort(spark):
    rows = [(1, 1, None, False), (1, 2, "bad", None), (1, 3, None, True), (1, 4, None, False), (2, 1, None, False), (None, 1, None, True), (None, 0, None, False)]
    items = spark.createDataFrame(rows, "batch int, pos int, failure string, aborted boolean")
    done = export.run_batch(items, ["batch"], "pos", F.col("pos"), F.col("failure"), F.col("aborted"))
    found = {(r.batch, r.pos): (r.status, r.error, r.output, r.done) for r in done.collect()}
    assert found == {
        (1, 1): ("ok", None, 1, True), (1, 2): ("error", "bad", None, True), (1, 3): ("cancelled", None, None, False), (1, 4): ("cancelled", None, None, False),
        (2, 1): ("ok", None, 1, True), (None, 1): ("cancelled", None, None, False), (None, 0): ("ok", None, 0, True),
    }
    assert export.summary(export.run_batch(items.limit(0), ["batch"], "pos", F.col("pos"), F.col("failure"), F.col("aborted")), ["batch"]).count() == 0


def test_area_scaling_keeps_means():
    """Against a plain sum over all pixels and their shares, up and down, in sizes that don't divide."""
    rng = np.random.default_rng(2)
    for (h, w), (sh, sw) in (((7, 10), (3, 4)), ((5, 4), (8, 9)), ((6, 6), (6, 6)), ((9, 2), (1, 1))):
        picture = rng.integers(0, 256, (h, w)).astype(np.uint8)
        share = lambda n, m: np.array([[max(0.0, min((i + 1) * n / m, j + 1) - max(i * n / m, j)) for j in range(n)] for i in range(m)]) * (m / n)
        wanted = share(h, sh) @ picture @ share(w, sw).T
        assert np.allclose(redact.area_scaled(picture, sw, sh), wanted)
        assert np.isclose(redact.area_scaled(picture, sw, sh).mean(), picture.mean())
