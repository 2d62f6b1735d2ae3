"""HDR frames against the column expressions, decoders that fail midway, and exports that are stopped."""

import os
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.functions import tonemap
from framesift.operators import decode, export, hdr


def planes(luma, blue, red):
    return b"".join(np.asarray(p, "<u2").tobytes() for p in (luma, blue, red))


def nearest(luma, blue, red, kr, kb):
    """Red, green and blue of one sample in limited range."""
    y, cb, cr = (luma - 64) / 876, (blue - 512) / 896, (red - 512) / 896
    r, b = y + 2 * (1 - kr) * cr, y + 2 * (1 - kb) * cb
    return [min(max(x, 0.0), 1.0) for x in (r, (y - kr * r - kb * b) / (1 - kr - kb), b)]


@pytest.mark.parametrize("transfer", ["hlg", "pq"])
def test_constant_and_gradient_frames(spark, transfer):
    width, height = 35, 131  # odd sizes, more than one band
    constants = [(64, 512, 512), (940, 512, 512), (500, 600, 450), (300, 400, 700), (720, 530, 520)]
    frames = [planes(np.full((height, width), y), np.full((66, 18), cb), np.full((66, 18), cr)) for y, cb, cr in constants]
    gradient = 64 + (np.arange(width * height) * 7 % 877).reshape(height, width)
    frames.append(planes(gradient, np.full((66, 18), 512), np.full((66, 18), 512)))
    rows = spark.createDataFrame([(i, width, height, f, "bt2020", transfer, None) for i, f in enumerate(frames)], "id int, width int, height int, planes binary, primaries string, transfer string, full_range boolean")
    found = {r.id: np.frombuffer(r.rgba, np.uint8).reshape(height, width, 4) for r in hdr.rendered(rows).collect()}
    samples = [nearest(*c, 0.2627, 0.0593) for c in constants] + [nearest(int(y), 512, 512, 0.2627, 0.0593) for y in gradient[0]]
    curve = {"hlg": tonemap.hlg, "pq": tonemap.pq}[transfer]
    wanted = spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(samples)], "i int, r double, g double, b double")
    wanted = [np.array(r[1:]) * 255 for r in wanted.select("i", *curve([F.col("r"), F.col("g"), F.col("b")])).orderBy("i").collect()]
    for i in range(len(constants)):
        assert (found[i][:, :, 3] == 255).all() and np.abs(found[i][:, :, :3] - wanted[i]).max() <= 1
    assert np.abs(found[5][0, :, :3] - np.stack(wanted[5:])).max() <= 1


def test_chroma_between_samples():
    plane = np.array([[0.0, 100.0], [200.0, 300.0]])
    assert hdr.upsampled(plane, np.arange(4), 4).tolist() == [[0, 50, 100, 100], [50, 100, 150, 150], [150, 200, 250, 250], [200, 250, 300, 300]]


def test_routing_nulls_and_sizes(spark):
    good = planes(np.full((2, 2), 1023), [[512]], [[512]])
    rows = [(0, 2, 2, good, "bt709", "bt709", True), (1, 2, 2, good, "bt2020", None, True), (2, 2, 2, good, None, None, None), (3, 2, 2, None, "bt2020", "pq", None), (4, 3, 2, good, "bt2020", "pq", None), (5, None, 2, good, None, None, None)]
    df = spark.createDataFrame(rows, "id int, width int, height int, planes binary, primaries string, transfer string, full_range boolean")
    found = {r.id: (r.effective, r.rgba and r.rgba.hex()) for r in hdr.rendered(df).collect()}
    assert found[0] == (None, "ff" * 16) and found[1][0] == "hlg" and len(found[1][1]) == 32
    assert found[2][0] is None and found[3] == ("pq", None) and found[4] == ("pq", None) and found[5] == (None, None)
    assert {r.effective for r in hdr.rendered(df, F.lit(False)).collect()} == {None}
    assert hdr.rendered(df.limit(0)).count() == 0


class Stub:
    """Gives each packet's frame one packet late, the first one twice; fails at the packets of ``bad``."""

    def __init__(self, bad, log):
        self.bad, self.log, self.held = bad, log, []

    def decode(self, packet):
        if packet["data"] in self.bad:
            raise ValueError("broken")
        ready, self.held = self.held, [(packet["pts_us"], packet["data"])] * (2 if packet["key"] else 1) + [(-1, b"from before")]
        return ready

    def flush(self):
        if b"flush" in self.bad:
            raise ValueError("at the end")
        return self.held


def test_no_frame_lost_or_twice(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for path in "abc":
        gop = 0
        for n in range(200):
            key = n == 0 or bool(rng.random() < 0.1)
            gop = n if key else gop
            data = bytes([int(rng.integers(0, 40))])
            rows.append((path, gop, n, key, n * 10 + 1, 10, data))
            want.setdefault((path, gop), []).append((n * 10 + 1, data))
    bad = [{bytes([1]), bytes([2])}, {bytes([2]), bytes([3])}, {bytes([3]), bytes([2])}]
    modes = [(name, lambda b=b: Stub(b, [])) for name, b in zip(("one", "two", "three"), bad)]
    df = spark.createDataFrame(rows, "path string, gop bigint, n bigint, key boolean, pts_us bigint, dur_us bigint, data binary").repartition(7)
    found = {}
    for r in decode.decoded(df, modes).collect():
        found.setdefault((r.path, r.gop), []).append((r.pts_us, r.mode, r.frame and bytes(r.frame), r.error))
    assert set(found) == set(want)
    for key, packets in want.items():
        mode = next((name for name, b in zip(("one", "two", "three"), bad) if not b & {d for _, d in packets}), None)
        if mode is None:
            assert found[key] == [(None, None, None, "three: broken")]
        else:
            assert sorted(found[key]) == [(t, mode, d, None) for t, d in packets]
    assert {f[0][1] for f in found.values()} >= {"one", "two", None}


def test_modes_that_end_badly(spark):
    schema = "path string, gop bigint, n bigint, key boolean, pts_us bigint, dur_us bigint, data binary"
    df = spark.createDataFrame([("a", 0, 0, True, 5, 1, b"x"), (None, 0, 1, True, 6, 1, b"x"), ("a", 0, 1, None, 5, 1, b"y")], schema)

    def missing():
        raise OSError("no such decoder")

    modes = [("none", missing), ("late", lambda: Stub({b"flush"}, [])), ("good", lambda: Stub(set(), []))]
    assert [(r.pts_us, r.mode, bytes(r.frame)) for r in decode.decoded(df, modes).collect()] == [(5, "good", b"x")]
    assert [r.error for r in decode.decoded(df, []).collect()] == ["no decoder"]
    assert decode.decoded(df.limit(0), modes).count() == 0


def rendered(seconds):
    """Items' files; an item past 60 takes long."""

    def render(items):
        def run(batches):
            for batch in batches:
                if any((i or 0) >= 60 for i in batch.column("id").to_pylist()):
                    time.sleep(seconds)
                yield batch

        slow = items.select("id").mapInArrow(run, "id bigint")
        return slow.select(F.concat(F.lit("f"), "id").alias("name"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"), F.lit(0).alias("exported_at"))

    return render


def test_abort_stops_running_work(spark, tmp_path):
    folder, flag = str(tmp_path / "out"), threading.Event()
    items, began = spark.range(0, 100, 1, 2), time.time()

    def cancelled():
        # the third of five steps is finished: the fourth one runs, for ten minutes
        if os.path.isdir(folder) and "f59" in os.listdir(folder):
            flag.set()
        return flag.is_set()

    found = export.export_until(items, "id", rendered(600), folder, cancelled, steps=5)
    assert time.time() - began < 120
    status = {r.id: r.status for r in found.collect()}
    assert all(status[i] == ("ok" if i < 60 else "cancelled") for i in range(100))
    assert {f for f in os.listdir(folder) if f[0] != "."} == {f"f{i}" for i in range(60)}


def test_export_to_the_end_and_failures(spark, tmp_path):
    items = spark.range(100).withColumn("id", F.when(F.col("id") > 0, F.col("id")))
    found = export.export_until(items, "id", rendered(0), str(tmp_path / "all"), lambda: False, steps=3)
    assert found.where("status = 'ok'").count() == 100 and len([f for f in os.listdir(tmp_path / "all") if f[0] != "."]) == 99
    nulls = items.withColumn("id", F.lit(None).cast("bigint"))
    assert export.export_until(nulls, "id", rendered(0), str(tmp_path / "nulls"), lambda: False).where("status = 'ok'").count() == 100
    assert export.export_until(items.limit(0), "id", rendered(0), str(tmp_path / "none"), lambda: False).count() == 0
    assert export.export_until(items, "id", rendered(0), str(tmp_path / "none"), lambda: True).where("status = 'ok'").count() == 0
    broken = lambda rows: rendered(0)(rows).withColumn("content", F.raise_error(F.lit("disk full")).cast("binary"))
    with pytest.raises(Exception, match="disk full"):
        export.export_until(items, "id", broken, str(tmp_path / "bad"), lambda: False)
