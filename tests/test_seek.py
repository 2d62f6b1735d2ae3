"""Windows over stretches of time: whatever the stretch, the results are those of plain Python over the whole sequence."""

import random

import pytest
from pyspark.sql import functions as F

from framesift.operators import progress, seek

STRETCHES = [7, 50, 10**9]


@pytest.fixture(scope="module")
def log(spark):
    rnd = random.Random(3)
    # file 1 holds most rows; times have ties and gaps; a null file and a null time belong to no sequence
    rows = [(1 if rnd.random() < 0.7 else rnd.randrange(2, 6), i, rnd.randrange(400), rnd.random() < 0.8, rnd.randrange(100) / 10) for i in range(300)]
    rows += [(None, 900, 5, True, 1.0), (1, 901, None, True, 1.0)]
    df = spark.createDataFrame(rows, "file_id bigint, frame_id bigint, pts_us bigint, active boolean, ms double").withColumn("seq", F.col("frame_id"))
    files = {}
    for r in rows:
        if None not in r:
            files.setdefault(r[0], []).append(r)
    return df.repartition(3), {k: sorted(v, key=lambda r: (r[2], r[1])) for k, v in files.items()}


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("stretch", STRETCHES)
def test_as_of(spark, log, stretch):
    df, files = log
    asked = [(k, t) for k in [*files, 99] for t in range(-3, 420, 17)]
    found = seek.latest_before(spark.createDataFrame([*asked, (None, 3)], "file_id bigint, at_us bigint"), df, stretch)
    wanted = []
    for k, t in asked:
        past = [r for r in files.get(k, []) if r[2] <= t]
        wanted.append((k, t, past[-1][1] if past else None, past[-1][2] if past else None))
    assert sorted(map(str, map(tuple, found.select("file_id", "at_us", "frame_id", "pts_us").collect()))) == sorted(map(str, wanted))


@pytest.mark.parametrize("stretch", STRETCHES)
def test_debounce_pacing_and_numbers(log, stretch):
    df, files = log
    last = [(k, a[1]) for k, v in files.items() for a, b in zip(v, [*v[1:], None]) if b is None or b[2] - a[2] >= 4]
    assert pairs(seek.debounced(df, 4, stretch), "file_id", "frame_id") == sorted(last)
    due = [(r[1], (r[2] - v[0][2]) / 1000, 10 + (r[2] - v[0][2]) / 1000 < 10.1) for v in files.values() for r in v]
    assert pairs(seek.paced(df, F.lit(10.1), F.lit(10.0), stretch), "frame_id", "target_ms", "late") == sorted(due)
    numbers = [(k, r[1], n, len({x[1] % 7 for x in v})) for k, v in files.items() for n, r in enumerate(v, 1)]
    assert pairs(seek.numbered(df, F.col("frame_id") % 7, stretch), "file_id", "frame_id", "n", "signatures") == sorted(numbers)


@pytest.mark.parametrize("stretch", STRETCHES)
def test_hangs_and_averages(log, stretch):
    df, files = log
    wanted, averages = [], []
    for k, v in files.items():
        run, total = [], 0
        for before, r in zip([None, *v], v):
            gap = before and r[2] - before[2]
            if before and gap > 3 and r[3]:
                run.append((r[2], gap))
            elif run:
                wanted.append((k, min(t - g for t, g in run), max(g for _, g in run), len(run)))
                run = []
        if run:
            wanted.append((k, min(t - g for t, g in run), max(g for _, g in run), len(run)))
        for n, r in enumerate(v, 1):
            total += round(r[4] * 100)
            averages.append((r[1], total / n))
    assert pairs(seek.hang_episodes(df, 3, stretch), "file_id", "started_us", "longest_us", "n") == sorted(wanted)
    assert pairs(progress.running_average(df, ["file_id"], stretch), "seq", "average") == sorted(averages)


def test_ring_keeps_the_latest(log):
    df, files = log
    wanted = sorted((k, r[1], n) for k, v in files.items() for n, r in enumerate(reversed(v), 1) if n <= 4)
    assert pairs(seek.latest_entries(df.dropna(), 4), "file_id", "frame_id", "n") == wanted


def test_empty_logs(log):
    none = log[0].limit(0)
    assert seek.debounced(none, 4).count() == seek.hang_episodes(none, 4).count() == seek.numbered(none, F.col("frame_id")).count() == 0
    assert seek.latest_before(none.select("file_id", F.col("pts_us").alias("at_us")), none).count() == 0
