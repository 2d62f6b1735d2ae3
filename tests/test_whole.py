"""Queries that must do the whole job, against plain Python over all rows."""

import random
from collections import defaultdict

from framesift.operators import nms, overlap
from framesift.plans import all_queries, detections
from framesift.sources.tables import frames, inferences

QUERIES, _ = all_queries()


def suppressed(spark, sf_dir):
    """Confidence of the boxes that greedy suppression keeps, by frame, label and anchor."""
    groups = defaultdict(list)
    for r in nms.class_candidates(detections.raw_boxes(spark, sf_dir)).collect():
        groups[r.frame_id, r.label].append(r)
    kept = {}
    for (frame, label), boxes in groups.items():
        stay = []
        for b in sorted(boxes, key=lambda r: (-r.conf, r.anchor))[: nms.TOP]:
            for a in stay:
                w = min(a.cx + a.w / 2, b.cx + b.w / 2) - max(a.cx - a.w / 2, b.cx - b.w / 2)
                h = min(a.cy + a.h / 2, b.cy + b.h / 2) - max(a.cy - a.h / 2, b.cy - b.h / 2)
                inter = max(0, w) * max(0, h)
                union = a.w * a.h + b.w * b.h - inter
                if union > 0 and inter / union > nms.OVERLAP:
                    break
            else:
                stay.append(b)
        kept |= {(frame, label, b.anchor): b.conf for b in stay}
    return kept


def regions(spark, sf_dir):
    """Regions of the kept boxes of each frame as suppression returns them: label after label, plates first, in each from the best down."""
    kept, frames = suppressed(spark, sf_dir), defaultdict(list)
    for r in QUERIES["blur_region"](spark, sf_dir).collect():
        if (r.frame_id, r.label, r.anchor) in kept:
            frames[r.frame_id].append(r)
    assert max(sum(r.label == "plate" for r in v) for v in frames.values()) > 6
    return {k: sorted(v, key=lambda r: (nms.LABELS.index(r.label), -kept[k, r.label, r.anchor], r.anchor)) for k, v in frames.items()}


def meet(a, b):
    return not (a.xe <= b.xi or b.xe <= a.xi or a.ye <= b.yi or b.ye <= a.yi)


def test_overlap_pairs_of_all_detections(spark, sf_dir):
    wanted = set()
    for frame, boxes in regions(spark, sf_dir).items():
        boxes = sorted(boxes, key=lambda r: (r.label, r.anchor))
        wanted |= {(frame, a.label, a.anchor, b.label, b.anchor) for i, a in enumerate(boxes) for b in boxes[i + 1 :] if meet(a, b)}
    found = [tuple(r) for r in QUERIES["overlap_pairs"](spark, sf_dir).collect()]
    assert len(found) == len(wanted) and set(found) == wanted


def test_overlap_batches_of_all_detections(spark, sf_dir):
    wanted = {}
    for frame, boxes in regions(spark, sf_dir).items():
        groups = []
        for a in boxes:
            i = next((i for i, g in enumerate(groups) if not any(meet(a, b) for b in g)), len(groups))
            groups[i : i + 1] = [(groups[i] if i < len(groups) else []) + [a]]
            wanted[frame, a.label, a.anchor] = i + 1
    found = {(r.frame_id, r.label, r.anchor): r.batch for r in QUERIES["overlap_batches"](spark, sf_dir).collect()}
    assert found == wanted


def test_first_fit_follows_confidence(spark):
    """Three boxes in a row: the middle one meets both others. From the surest down, the outer two share a batch unless the middle one comes first."""
    box = lambda frame, label, anchor, conf, x: (frame, label, anchor, conf, x, 0, x + 10, 10)
    rows = [box(1, "plate", 1, 0.9, 0), box(1, "plate", 2, 0.8, 5), box(1, "plate", 3, 0.7, 12)]
    rows += [box(2, "plate", 1, 0.1, 0), box(2, "plate", 2, 0.8, 5), box(2, "plate", 3, 0.7, 12)]
    rows += [box(3, "person", 1, 0.99, 0), box(3, "plate", 2, 0.1, 5), box(3, "other", 4, 1.0, 0), box(3, "person", 3, None, 0), box(3, "person", 5, float("nan"), 0)]
    rows += [box(None, "plate", 1, 0.5, 0), box(None, "plate", 1, 0.5, 0), (4, "plate", 1, 0.5, None, 0, 10, 10), (4, None, 2, 0.5, 0, 0, 10, 10)]
    df = spark.createDataFrame(rows, "frame_id bigint, label string, anchor bigint, conf double, xi bigint, yi bigint, xe bigint, ye bigint")
    found = sorted(((r.frame_id or 0, r.label or "", r.anchor), r.batch) for r in overlap.batches(df).collect())
    assert found == [
        ((0, "plate", 1), 1), ((0, "plate", 1), 2), ((1, "plate", 1), 1), ((1, "plate", 2), 2), ((1, "plate", 3), 1), ((2, "plate", 1), 2), ((2, "plate", 2), 1), ((2, "plate", 3), 2),
        ((3, "other", 4), 5), ((3, "person", 1), 2), ((3, "person", 3), 3), ((3, "person", 5), 4), ((3, "plate", 2), 1), ((4, "", 2), 1),
    ]
    pairs = {(r.frame_id, r.label_a, r.anchor_a, r.label_b, r.anchor_b) for r in overlap.overlapping(df.where("frame_id = 1 or frame_id is null")).collect()}
    assert pairs == {(1, "plate", 1, "plate", 2), (1, "plate", 2, "plate", 3), (None, "plate", 1, "plate", 1)}
    assert overlap.batches(df.limit(0)).collect() == overlap.overlapping(df.limit(0)).collect() == []


def test_crowded_frames_in_blocks(spark, monkeypatch):
    """More boxes than a block, in batches that cut frames, against a plain loop."""
    rng = random.Random(4)
    rows = []
    for frame, n in ((1, 700), (2, 1), (3, 40), (4, 600)):
        for anchor in range(n):
            x, y = rng.randrange(2000), rng.randrange(2000)
            rows.append((frame, "plate", anchor, rng.random(), x, y, x + 1 + rng.randrange(80), y + 1 + rng.randrange(80)))
    df = spark.createDataFrame(rows, "frame_id bigint, label string, anchor bigint, conf double, xi bigint, yi bigint, xe bigint, ye bigint").repartition(1)
    met = lambda a, b: max(a[4], b[4]) < min(a[6], b[6]) and max(a[5], b[5]) < min(a[7], b[7])
    wanted = {(a[0], a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2] and met(a, b)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        pairs = [(r.frame_id, r.anchor_a, r.anchor_b) for r in overlap.overlapping(df).collect()]
        placed = {(r.frame_id, r.anchor): r.batch for r in overlap.batches(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(pairs) == len(wanted) and set(pairs) == wanted
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], -r[3])):
        own = groups[r[0]]
        i = next((i for i, g in enumerate(own) if not any(met(r, o) for o in g)), len(own))
        own[i : i + 1] = [(own[i] if i < len(own) else []) + [r]]
        assert placed[r[0], r[2]] == i + 1


def test_every_frame_is_exported(spark, sf_dir):
    files = defaultdict(list)
    for r in frames(spark, sf_dir).collect():
        files[r.file_id].append((r.pts_us, r.frame_id))
    wanted = {(k, f, n, len({f % 256 for _, f in v})) for k, v in files.items() for n, (_, f) in enumerate(sorted(v), 1)}
    found = [(r.file_id, r.frame_id, r.n, r.signatures) for r in QUERIES["exported_frames"](spark, sf_dir).collect()]
    assert len(found) == len(wanted) and set(found) == wanted


def test_every_inference_counts(spark, sf_dir):
    wanted = {"detect_n": [0, 0], "detect_x": [0, 0], "detect_z": [0, 0]}
    for r in inferences(spark, sf_dir).collect():
        wanted[r.model][0] += 1
        wanted[r.model][1] += round(r.ms * 100)
    found = {r.model: r for r in QUERIES["inference_stats"](spark, sf_dir).collect()}
    assert {k: [r.n, r.total_hundredths] for k, r in found.items()} == wanted
    assert all(r.average == (r.total_hundredths / r.n if r.n else None) for r in found.values())
    assert {r.model: r.n for r in QUERIES["stream_stats"](spark, sf_dir).collect()} == {k: v[0] for k, v in wanted.items() if v[0]}


def test_window_counts_in_any_file_order(spark, tmp_path):
    for at, name in enumerate(["2024-01-05", "2020-01-05", "2022-01-05"]):
        row = spark.createDataFrame([(at, 1, name + " 10:30:00", "view", 1.0)], "event_id bigint, user_id bigint, ts string, event_type string, value double")
        row.withColumn("ts", row.ts.cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert sum(r.n for r in QUERIES["stream_window_counts"](spark, str(tmp_path)).collect()) == 3
