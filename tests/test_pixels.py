"""Pixel and byte operators: relations that must hold on checkerboards and synthetic JPEG bytes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.operators import exif, nms, redact
from framesift.sources.pictures import checkerboard, exif_jpeg, segment

EXIF = segment(0xE1, b"Exif\0\0" + b"II*\0\x08\0\0\0\0\0")


def test_finds_exif_in_segments():
    assert exif.find_exif(None) is None and exif.find_exif(b"") is None and exif.find_exif(b"\xff\xd8") is None
    assert exif.find_exif(b"\xff\xd8" + EXIF) == EXIF
    assert exif.find_exif(b"\xff\xd8" + segment(0xE0, b"JFIF\0") + EXIF + b"rest") == EXIF
    assert exif.find_exif(b"\xff\xd8" + segment(0xE1, b"http://ns") + EXIF) == EXIF
    assert exif.find_exif(b"\xff\xd8" + segment(0xDA, b"x") + EXIF) is None
    assert exif.find_exif(b"\xff\xd8\x00\x00" + EXIF) is None
    assert exif.find_exif(b"\xff\xd8" + EXIF + EXIF) == EXIF


@pytest.mark.parametrize("key", range(12))
def test_exif_keeps_reduces_and_strips(key):
    jpeg = exif_jpeg(key, "2024:03:15 10:42:00")
    meta = exif.read_meta(jpeg)
    assert (meta["year"], meta["minute"], meta["timezone"]) == ("2024", "42", "+01:00")
    assert ("lat" in meta) == (key % 2 == 0)
    bare = exif.carry_over(jpeg, jpeg, "strip")
    assert exif.read_meta(bare) == {}
    assert exif.carry_over(jpeg, bare, "keep") == jpeg
    placed = exif.read_meta(exif.carry_over(jpeg, jpeg, "gps"))
    if key % 2 == 0:
        assert placed == {"lat": meta["lat"], "lon": meta["lon"]}
    else:
        assert exif.place_only(jpeg) is None


def test_broken_exif_is_missing():
    jpeg = exif_jpeg(4, "2024:03:15 10:42:00")
    for cut in range(0, len(jpeg), 3):
        exif.read_meta(jpeg[:cut])
        exif.place_only(jpeg[:cut])
    assert exif.read_meta(bytes(range(64))) == {}


BOX = redact.Box(100, 100, 80, 60, (15, 15, 15, 15))


def changed(f):
    before = checkerboard(400, 300)
    after = before.copy()
    f(after, BOX)
    return before, after


def test_solid_paints_inside_only():
    before, after = changed(lambda p, b: redact.fill(p, b, (1, 2, 3)))
    assert (after[130, 140, :3] == (1, 2, 3)).all()
    assert (after[:95] == before[:95]).all() and (after[:, 185:] == before[:, 185:]).all()
    assert (after[100, 100] == before[100, 100]).all()  # the corner is round
    assert (after[:, :, 3] == 255).all()


def test_pixelate_makes_blocks():
    before, after = changed(redact.pixelate)
    inside = after[100:160, 100:180, :3].reshape(-1, 3)
    assert len(np.unique(inside, axis=0)) <= 80 and not (after[100:160, 100:180] == before[100:160, 100:180]).all()
    assert (after[160:] == before[160:]).all() and (after[:100] == before[:100]).all()


def test_blur_mixes_inside_and_leaves_the_rest():
    before, after = changed(redact.blur)
    assert 60 < after[130, 140, 0] < 200 and 60 < after[130, 140, 2] < 200
    assert (after[:60] == before[:60]).all() and (after[240:] == before[240:]).all() and (after[:, 240:] == before[:, 240:]).all()
    assert not (after[102:158, 101] == before[102:158, 101]).all()  # up to the border


def test_blur_covers_a_snapped_edge():
    before = checkerboard(300, 300)
    after = before.copy()
    redact.blur(after, redact._clipped({"label": "plate", "x": 0.5, "y": 120.0, "w": 60.0, "h": 40.0}, 300, 300))
    assert (after[130:150, 0, :3] != before[130:150, 0, :3]).any(axis=1).all()


def test_blur_of_a_constant_is_constant():
    flat = np.full((40, 50, 3), 77, np.uint8)
    assert (redact.stack_blur(flat, 10) == 77).all()


def test_mask_falls_over_the_feather():
    m = redact.mask(60, 50, 5, 15, 12, redact.Box(15, 12, 30, 20, (4, 4, 4, 4)))
    assert m[22, 30] == 1 and m[0, 0] == 0 and 0 < m[22, 47] < 1
    snapped = redact.mask(60, 50, 5, 15, 12, redact.Box(15, 12, 30, 20, (0, 0, 0, 0), (True, False, False, False)))
    assert snapped[22, 0] == 1


def test_redact_leaves_frames_without_detections(spark):
    raw = checkerboard(16, 8).tobytes()
    rows = [(1, 16, 8, raw, []), (2, 16, 8, raw, None), (3, 16, 8, None, []), (4, 16, 8, b"short", [("plate", 1.0, 1.0, 4.0, 4.0)])]
    frames = spark.createDataFrame(rows, "frame_id int, width int, height int, rgba binary, detections array<struct<label:string,x:double,y:double,w:double,h:double>>")
    found = {r.frame_id: r.rgba for r in redact.redact(frames, "solid").collect()}
    assert found[1] == raw and found[2] == raw and found[3] is None and found[4] == b"short"
    assert redact.redact(frames.limit(0), "blur").count() == 0


def test_redact_passes_over_what_has_no_place(spark, monkeypatch):
    monkeypatch.setattr(redact, "GROUP_BYTES", 600)
    raw, box = checkerboard(16, 8).tobytes(), "array<struct<label:string,x:double,y:double,w:double,h:double>>"
    rows = [(1, 16, 8, raw, [("plate", None, 1.0, 4.0, 4.0), None, ("plate", float("nan"), 1.0, 4.0, 4.0)]), (2, 16, 8, raw, [("dog", 2.0, 2.0, 4.0, 4.0)]), (3, None, 8, raw, [("plate", 2.0, 2.0, 4.0, 4.0)]), (4, 16, 8, raw, [(None, 2.0, 2.0, 4.0, 4.0)])]
    frames = spark.createDataFrame(rows, f"frame_id int, width int, height int, rgba binary, detections {box}").coalesce(1)
    found = {r.frame_id: bytes(r.rgba) for r in redact.redact(frames, "solid", (1, 2, 3)).collect()}
    assert found[1] == found[3] == raw
    square = np.frombuffer(found[2], np.uint8).reshape(8, 16, 4)
    assert (square[2:6, 2:6, :3] == (1, 2, 3)).all() and found[4] == found[2] and (square[:, 7:] == checkerboard(16, 8)[:, 7:]).all()
    for mode in ("pixelate", "blur"):
        assert redact.redact(frames, mode).count() == 4
    odd = spark.createDataFrame([(None, 1, 1), (b"abc", 1, 1), (b"abcd", None, 1)], "rgba binary, w int, h int")
    assert all(r[0] is None for r in odd.select(redact.tensor(F.col("rgba"), F.col("w"), F.col("h"))).collect())
    lay = F.array(*[F.struct(F.lit(0).alias("offset"), F.lit(2).alias("stride"))] * 3)
    assert [r[0] for r in odd.select(redact.to_8_bit(F.col("rgba"), F.col("w"), F.col("h"), lay)).collect()] == [None, b"\x98", None]


@pytest.mark.parametrize("radius", [1, 2, 10, 50])
def test_running_sums_equal_the_weighted_blur(radius):
    """Every output sample against the triangle's weights over the samples around it, edges repeated."""
    image = np.random.default_rng(radius).integers(0, 256, (9, 13, 3))
    weights = np.array([*range(1, radius + 2), *range(radius, 0, -1)])
    for axis in (1, 0):
        n = image.shape[axis]
        at = np.clip(np.arange(n)[:, None] + np.arange(-radius, radius + 1), 0, n - 1)
        image = np.moveaxis(np.tensordot(np.moveaxis(image, axis, -1)[..., at], weights, axes=(-1, 0)) // weights.sum(), -1, axis)
    start = np.random.default_rng(radius).integers(0, 256, (9, 13, 3))
    assert (redact.stack_blur(start, radius) == image).all()


def test_dense_suppression_across_batches(spark):
    """Groups that are cut by batches, and null frames, come out as the fold has them."""
    rng = np.random.default_rng(4)
    rows = [(None if f == 9 else f, i, *map(float, rng.integers(0, 60, 2)), *map(float, rng.integers(5, 40, 2)), 1.0, float(rng.random()), float(rng.random())) for f in range(10) for i in range(40)]
    boxes = nms.class_candidates(spark.createDataFrame(rows, SCHEMA))
    wanted = sorted(map(str, map(tuple, nms.suppress(boxes).collect())))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(str, map(tuple, nms.suppress_dense(boxes).collect()))) == wanted
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tensor_is_planar(spark):
    raw = checkerboard(16, 8).tobytes()
    row = spark.createDataFrame([(raw, 16, 8)], "rgba binary, w int, h int").select(redact.tensor(F.col("rgba"), F.col("w"), F.col("h")).alias("t")).first()
    planes = np.frombuffer(row.t, "<f4").reshape(3, 8, 16)
    assert planes[0, 0, 0] == 1 and planes[2, 0, 0] == 0 and planes[2, 0, 8] == 1 and (planes[1] == 0).all()


def test_snapshot_pads_with_grey():
    out = redact.snapshot(checkerboard(64, 32), 128)
    assert out.shape == (128, 128, 4) and (out[:32] == redact.GREY).all() and (out[40, 1, :3] == (255, 0, 0)).all()


SCHEMA = "frame_id bigint, anchor bigint, cx double, cy double, w double, h double, obj double, c0 double, c1 double"


def test_suppression_edge_cases(spark):
    nan = float("nan")
    raw = spark.createDataFrame(
        [(1, 1, 10.0, 10.0, 4.0, 4.0, 0.9, 0.9, 0.0), (1, 2, 10.0, 10.0, 4.0, 4.0, 0.9, 0.9, 0.0), (1, 3, 11.0, 10.0, 4.0, 4.0, 0.9, 0.5, 0.5),
         (2, 1, 5.0, 5.0, 0.0, 0.0, 1.0, 1.0, 0.0), (2, 2, 5.0, 5.0, 0.0, 0.0, 1.0, 0.9, 0.0), (3, 1, 1.0, 1.0, 2.0, 2.0, nan, 1.0, 1.0), (4, 1, None, 1.0, 2.0, 2.0, None, 1.0, 1.0)], SCHEMA)
    boxes = nms.class_candidates(raw)
    for f in (nms.suppress, nms.suppress_dense):
        found = sorted((r.frame_id, r.label, r.anchor) for r in f(boxes).collect())
        assert found == [(1, "person", 3), (1, "plate", 1), (2, "plate", 1), (2, "plate", 2)]
        assert f(boxes.limit(0)).count() == 0


def test_filters(spark):
    found = spark.createDataFrame([("plate", 0.5), ("person", float("nan")), ("person", 0.01)], "label string, conf double")
    assert nms.filter_detections(found, 0.0, nms.LABELS).count() == 3
    assert nms.filter_detections(found, 0.05, nms.LABELS).count() == 1
    assert nms.filter_detections(found, 0.0, ()).count() == 0


def test_suppression_equals_the_fold(spark):
    """Groups of many sizes, NaN and empty boxes, in batches that cut groups; and no array of a group's boxes in the plan."""
    rng = random.Random(8)
    rows = []
    for frame in [*range(40), None]:
        for anchor in range(rng.choice([1, 2, 3, 30, 90])):
            side = lambda top: rng.choice([0.0, float("nan")]) if rng.random() < 0.02 else rng.random() * top
            rows.append((frame, rng.choice(["plate", "person", None]), anchor, rng.randrange(50) / 50, side(60), side(60), side(30), side(30)))
    boxes = spark.createDataFrame(rows, "frame_id bigint, label string, anchor bigint, conf double, cx double, cy double, w double, h double")
    wanted = sorted(map(str, map(tuple, nms.suppress_fold(boxes).collect())))
    assert 300 < len(wanted) < len(rows)
    for size in (7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert sorted(map(str, map(tuple, nms.suppress(boxes).collect()))) == wanted
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = nms.suppress(boxes)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Sort [") == 1


def test_partitions_of_pictures_are_small(spark, tmp_path):
    """What a Python worker is given at a time doesn't grow with the table."""
    from framesift.sources import pictures

    spark.range(3000).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    frames = pictures.checkerboards(spark, str(tmp_path))
    sizes = [r["n"] for r in frames.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 and max(sizes) <= pictures.FRAMES + 8


def test_samples_of_one_are_counted_without_text(spark, sf_dir):
    from framesift.plans import all_queries

    raw = np.array([1, 0, 1, 0.5, 1, 1], "<f4").tobytes()
    rows = spark.createDataFrame([(raw,), (None,), (b"abc",), (b"",)], "t binary").select(redact.samples_of_one(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [[1, 1, 2], None, None, [0, 0, 0]]
    plan = all_queries()[0]["tensor_build"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "hex" not in plan and "regexp" not in plan


def test_exif_goes_out_and_back_in_one_pass(spark, sf_dir):
    from framesift.plans import all_queries

    raw = [exif_jpeg(k, "2024:03:15 10:42:00") for k in range(6)] + [None, b"", b"\xff\xd8"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "k int, jpeg binary").withColumn("s", exif.exif_stripped_and_back(F.col("jpeg")))
    one = [(r.s.bare, r.s.again) for r in df.orderBy("k").collect()]
    assert one == [(bare := exif.carry_over(r, r, "strip"), exif.carry_over(r, bare, "keep")) for r in raw]
    plan = all_queries()[0]["exif_inject"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # one worker makes the pictures, one takes them through
    assert plan.count("ArrowEvalPython") <= 2
