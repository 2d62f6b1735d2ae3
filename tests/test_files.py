"""File heads, the sink of named files, and packets of movies."""

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framesift.sources import files, movies
from framesift.sources.pictures import exif_jpeg


class Counted:
    """A file that counts the bytes that are read."""

    def __init__(self, system):
        self.system, self.bytes = system, 0

    def open_input_file(self, path):
        return CountedFile(self, self.system.open_input_file(path))


class CountedFile:
    def __init__(self, owner, file):
        self.owner, self.file = owner, file

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def read_at(self, size, at):
        self.owner.bytes += size
        return self.file.read_at(size, at)


@pytest.fixture
def counted(monkeypatch):
    system, root = files.place("/tmp")
    counter = Counted(system)
    monkeypatch.setattr(files, "place", lambda path: (counter, path))
    return counter


def listing(folder):
    return {os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs if not f.endswith(".crc")}


def test_heads_of_files_of_any_size(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "sub" / "short").write_bytes(b"abc")
    (tmp_path / "_hidden").write_bytes(b"no")
    with open(tmp_path / "long.jpg", "wb") as file:  # 20 GB of hole: no cell could hold it
        file.write(exif_jpeg(4, "2024:03:15 10:42:00"))
        file.truncate(20 << 30)
    found = {os.path.basename(r.path): (r.length, bytes(r.head)) for r in files.heads(spark, f"file://{tmp_path}", per_task=2).collect()}
    assert set(found) == {"empty", "short", "long.jpg"}
    assert found["empty"] == (0, b"") and found["short"] == (3, b"abc")
    assert found["long.jpg"][0] == 20 << 30 and len(found["long.jpg"][1]) == 65536
    assert files.heads(spark, str(tmp_path), per_task=2).rdd.getNumPartitions() == 2
    assert files.heads(spark, str(tmp_path / "nothing")).count() == 0


def test_heads_read_no_more_than_asked(tmp_path, counted):
    for i in range(5):
        (tmp_path / str(i)).write_bytes(bytes(100_000))
    reader = files.HeadReader(str(tmp_path), 1000, 10)
    part = files.Files([(str(tmp_path / str(i)), 100_000, 0) for i in range(5)])
    assert sum(b.num_rows for b in reader.read(part)) == 5
    assert counted.bytes == 5000


def test_named_files(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [("a.jpg", b"old", 1), ("a.jpg", b"new", 2), ("b/c", b"x", 1), ("..", b"up", 1), ("", b"none", 1), (None, b"lost", 1), ("n", None, 1), ("tie", b"1", 1), ("tie", b"2", 1), ("é ü", b"u", 1)]
    files.write_named(spark.createDataFrame(rows, "name string, content binary, exported_at int"), folder)
    read = lambda: {os.path.basename(r.path): bytes(r.head) for r in files.heads(spark, folder).collect()}
    assert {n: open(f"{folder}/{n}", "rb").read() for n in listing(folder)} == {"a.jpg": b"new", "b_c": b"x", "_..": b"up", "_": b"none", "n": b"", "tie": b"2", "é ü": b"u"}
    assert "_" not in read()
    files.write_named(spark.createDataFrame([("a.jpg", b"again", 0), ("d", b"d", 0)], "name string, content binary, exported_at int"), folder)
    assert read()["a.jpg"] == b"again" and read()["b_c"] == b"x" and read()["d"] == b"d"
    files.write_named(spark.createDataFrame([], "name string, content binary, exported_at int"), folder)
    assert len(listing(folder)) == 8 and not os.listdir(f"{folder}/.staging")


def test_failed_write_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.range(0, 100, 1, 4).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 77, F.raise_error(F.lit("broken picture"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="broken picture"):
        files.write_named(rows, folder, distinct=True)
    assert {f for f in listing(folder) if not f.startswith(".staging/")} == set() and files.recover(spark, folder) == 0


def test_attempts_and_recovery(spark, tmp_path):
    """A second attempt takes the place of the first; a commit whose files weren't all moved is finished later."""
    folder, staging = str(tmp_path / "out"), str(tmp_path / "out/.staging/one")
    writer = files.NamedWriter(staging)
    batch = lambda content: [pa.RecordBatch.from_pydict({"name": ["a", "b"], "content": [content, content]})]
    writer.write(iter(batch(b"lost")))
    second = writer.write(iter(batch(b"kept")))
    assert files.recover(spark, folder) == 0 and listing(folder) >= {".staging/one/" + os.path.basename(second.folder) + "/a"}
    writer.commit([second, None])
    os.rename(f"{second.folder}/a", f"{folder}/a")  # a task moved one file and was lost
    assert files.recover(spark, folder) == 1 and files.recover(spark, folder) == 0
    assert listing(folder) == {"a", "b"} and open(f"{folder}/a").read() == open(f"{folder}/b").read() == "kept"


RETRIED = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from framesift.sources import files
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", sys.argv[1] + "/w").getOrCreate()

def fail_once(batches):
    for batch in batches:
        yield batch
    if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() % 2:
        raise RuntimeError("executor lost")

rows = spark.range(0, 400, 1, 4).selectExpr("concat('f', id) name", "cast(string(id) as binary) content").mapInArrow(fail_once, "name string, content binary")
files.write_named(rows, sys.argv[1] + "/out", distinct=True)
"""


def test_tasks_that_run_again(tmp_path):
    run = subprocess.run([sys.executable, "-c", RETRIED, str(tmp_path)], capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert run.returncode == 0, run.stderr[-2000:]
    folder = tmp_path / "out"
    assert listing(folder) == {f"f{i}" for i in range(400)}
    assert all((folder / f"f{i}").read_text() == str(i) for i in range(400))


def plain(start, durations, keys, packets, shifts, per_chunk):
    """Packets one by one: number, group, key, time, duration, place, size, bytes."""
    at, time, gop, found = 20 + 16, start, 0, []
    for i, (d, k, p, s) in enumerate(zip(durations, keys, packets, shifts)):
        gop = i if k else gop
        found.append((i, gop, k, time + s, d, at, len(p), p))
        time, at = time + d, at + len(p)
    return found


@pytest.mark.parametrize("seed", range(8))
def test_packets_of_a_movie(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    n = (0, 1, 5, 7, 100, 333, 20, 64)[seed]
    durations = rng.choice([40_000, 33_367, 0], n).tolist()
    keys = [True] * n if seed == 6 else [i == 0 or bool(rng.random() < 0.2) for i in range(n)]
    packets = [rng.bytes(int(rng.integers(0, 50))) for _ in range(n)]
    shifts = rng.choice([0, 80_000, -40_000], n).tolist() if seed % 2 else [0] * n
    start, per_chunk = int(rng.integers(0, 1 << 45)), int(rng.integers(1, 9))
    (tmp_path / "m.mp4").write_bytes(movies.movie(start, durations, keys, packets, shifts if seed % 2 else None, per_chunk))
    want = plain(start, durations, keys, packets, shifts, per_chunk)
    for split in (64 << 20, 97):  # whole, and cut so that every task has some packets
        found = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r[1:-1]) for r in movies.packets(spark, str(tmp_path), split=split).collect()]
        assert sorted(found) == want
    low, high = (want[n // 3][3], want[n // 2][3]) if n else (0, 1)
    asked = movies.packets(spark, str(tmp_path), low, high)
    assert sorted(r.n for r in asked.collect()) == [w[0] for w in want if low <= w[3] <= high]


def test_only_asked_packets_are_read(tmp_path, counted):
    n = 1000
    path = tmp_path / "m.mp4"
    path.write_bytes(movies.movie(0, [1000] * n, [True] * n, [bytes(500)] * n))
    part = movies.Part([(str(path), path.stat().st_size, 0, 1 << 40)])
    whole = sum(b.num_rows for b in movies.PacketReader(str(tmp_path), 1 << 40, None, None).read(part))
    everything, counted.bytes = counted.bytes, 0
    some = sum(b.num_rows for b in movies.PacketReader(str(tmp_path), 1 << 40, 10_000, 19_000).read(part))
    assert (whole, some) == (n, 10)
    assert counted.bytes == everything - 990 * 500


def test_filters_are_pushed(spark, tmp_path):
    n = 50
    (tmp_path / "m.mp4").write_bytes(movies.movie(7, [1000] * n, [True] * n, [b"x"] * n))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = movies.packets(spark, str(tmp_path)).where("pts_us > 10007 AND pts_us <= 20007")
        assert sorted(r.n for r in found.collect()) == list(range(11, 21))
        assert movies.packets(spark, str(tmp_path)).count() == n
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    reader = movies.PushedReader("", 1, 5, None)
    kept = [GreaterThan(("pts_us",), 3), LessThanOrEqual(("pts_us",), 90), EqualTo(("n",), 4)]
    assert list(reader.pushFilters(kept)) == kept and (reader.start, reader.end) == (5, 90)


def test_damaged_movies_fail_alone(spark, tmp_path):
    good = movies.movie(0, [1000] * 9, [True] * 9, [b"abc"] * 9)
    (tmp_path / "good.mp4").write_bytes(good)
    (tmp_path / "empty.mp4").write_bytes(b"")
    (tmp_path / "head.mp4").write_bytes(movies.box("ftyp", bytes(16)))
    (tmp_path / "noise.mp4").write_bytes(bytes(range(64)))
    (tmp_path / "cut.mp4").write_bytes(good[:-30])
    (tmp_path / "far.mp4").write_bytes(good.replace((36).to_bytes(4, "big") + (51).to_bytes(4, "big"), (36).to_bytes(4, "big") + (1 << 30).to_bytes(4, "big")))
    found = movies.packets(spark, str(tmp_path)).groupBy(F.element_at(F.split("path", "/"), -1).alias("f")).agg(F.count("data").alias("n"), F.max("error").alias("e"))
    rows = {r.f: (r.n, r.e) for r in found.collect()}
    assert rows.pop("good.mp4") == (9, None)
    assert set(rows) == {"empty.mp4", "head.mp4", "noise.mp4", "cut.mp4", "far.mp4"}
    assert all(n == 0 and e for n, e in rows.values())
    for at in range(0, len(good), 3):  # whatever byte is wrong, it is packets or an error
        bad = bytearray(good)
        bad[at] ^= 0xFF
        (tmp_path / "bad").mkdir(exist_ok=True)
        path = tmp_path / "bad" / "x.mp4"
        path.write_bytes(bytes(bad))
        part = movies.Part([(str(path), len(bad), 0, 1 << 40)])
        list(movies.PacketReader(str(tmp_path), 1 << 40, None, None).read(part))


def test_movies_of_null_and_empty_rows(spark, tmp_path):
    rows = [("a", 5, 1, None, None), ("a", 5, 0, False, b"first"), (None, 1, 2, True, b"x"), ("b", None, 3, True, b"x"), ("a", 9, 4, True, b"")]
    made = movies.movies(spark.createDataFrame(rows, "name string, pts_us bigint, frame_id bigint, key boolean, data binary"))
    files.write_named(made, str(tmp_path), distinct=True)
    found = [(r.n, r.key, r.pts_us, r.dur_us, bytes(r.data)) for r in movies.packets(spark, str(tmp_path)).orderBy("n").collect()]
    assert found == [(0, True, 5, 0, b"first"), (1, False, 5, 4, b""), (2, True, 9, 40_000, b"")]


def test_small_files_stand_in_packs(spark, tmp_path):
    rows = [(f"{k}", bytes([k % 251]) * (k % 40)) for k in range(500)] + [("long", b"ab" * 5000), ("after", b"xyz"), ("null", None), (None, b"gone"), ("after", b"again")]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    index = files.pack(df, str(tmp_path / "out"), most=4000)
    found = sorted((r.name, r.length, bytes(r.head)) for r in files.packed_heads(index, size=100).collect())
    assert found == sorted((n, len(c or b""), (c or b"")[:100]) for n, c in rows if n)
    packs = os.listdir(tmp_path / "out" / "packs")
    assert len(packs) == index.select("pack").distinct().count() < 12
    assert files.packed_heads(files.pack(df.limit(0), str(tmp_path / "none"))).collect() == []


def test_long_members_are_read_by_their_heads(spark, tmp_path):
    body = os.urandom(1 << 20)
    index = files.pack(spark.createDataFrame([("a", b"1"), ("b", body), ("c", b"3")], "name string, content binary").coalesce(1), str(tmp_path))
    assert [bytes(r.head) for r in files.packed_heads(index, size=10).orderBy("name").collect()] == [b"1", body[:10], b"3"]


def test_head_exif_makes_no_file_for_each_picture(spark, sf_dir, tmp_path, monkeypatch):
    from framesift.plans import files as plans

    monkeypatch.setattr(plans, "shared_folder", lambda *_: str(tmp_path / "pictures"))
    assert plans.head_exif(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert len(listing(tmp_path)) < 20
