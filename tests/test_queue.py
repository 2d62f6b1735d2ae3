"""The queue of one against a plain simulation of events in time."""

import random

from framesift.operators import queue

SCHEMA = "file_id bigint, frame_id bigint, pts_us bigint, service_us bigint"


def simulate(requests):
    """Time step by time step: completions first, then arrivals; a waiting request starts when the server is free and no other comes at that time."""
    wanted = {}
    for file in {r[0] for r in requests}:
        own = sorted({(r[2], r[1], r[3]) for r in requests if r[0] == file})
        wanted |= {(file, f, t): (None, None) for t, f, _ in own}
        busy, waiting, i = None, None, 0
        while i < len(own) or waiting:
            now = min([r[0] for r in own[i : i + 1]] + [busy] * (waiting is not None))
            while i < len(own) and own[i][0] == now:
                waiting, i = own[i], i + 1
            if busy is None or busy <= now:
                busy = now + waiting[2]
                wanted[file, waiting[1], waiting[0]] = (now, busy)
                waiting = None
    return wanted


def found(df, stretch_us):
    rows = queue.latest_wins(df, stretch_us).collect()
    assert all(r.superseded == (r.started_us is None) for r in rows)
    out = {(r.file_id, r.frame_id, r.pts_us): (r.started_us, r.completed_us) for r in rows}
    assert len(out) == len(rows)
    return out


def test_long_services_over_many_stretches(spark):
    rng = random.Random(1)
    rows = [(file, k, rng.randrange(400), rng.choice([0, 1, 5, 40, load])) for file, load in ((1, 3), (2, 90), (3, 5000)) for k in range(60)]
    wanted = simulate(rows)
    assert any(a is not None and a > k[2] for k, (a, _) in wanted.items())
    df = spark.createDataFrame(rows, SCHEMA)
    for stretch in (13, 1000):
        assert found(df, stretch) == wanted


def test_ties_nulls_and_repeats(spark):
    rows = [(1, 1, 10, 5), (1, 2, 10, 5), (1, 3, 15, 5), (1, 3, 15, 5), (1, 4, 16, 1), (1, 5, 20, 1), (1, 5, 90, 1), (2, 1, 0, -7)]
    odd = [(None, 1, 1, 1), (1, None, 1, 1), (1, 9, None, 1), (1, 9, 1, None)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    # a request that comes when the server gets free has waited; of two at once the last counts
    assert found(df, 10) == {(1, 1, 10): (None, None), (1, 2, 10): (10, 15), (1, 3, 15): (15, 20), (1, 4, 16): (None, None), (1, 5, 20): (20, 21), (1, 5, 90): (90, 91), (2, 1, 0): (0, 0)}
    assert found(df.limit(0), 10) == {}


def test_a_file_is_one_run_in_one_shuffle_and_busy_files_are_cut(spark):
    rng = random.Random(2)
    rows = [(file, k, rng.randrange(400), rng.choice([0, 1, 5, 40, load])) for file, load in ((1, 3), (2, 90), (3, 5000)) for k in range(60)]
    rows += [(4, 1, 5, 7), (4, 1, 5, 9), (5, 1, 0, 10), (5, 2, 13, 1), (5, 2, 13, 1)]
    wanted = simulate([r for r in rows if r != (4, 1, 5, 7) and r != (4, 1, 5, 9)] + [(4, 1, 5, 9)])
    df = spark.createDataFrame(rows, SCHEMA)
    # few requests: no rounds over stretches, whatever their number
    whole = queue.latest_wins(df, 13)
    assert whole._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    assert found(df, 13) == wanted
    for most in (1, 7, 50):
        out = queue.latest_wins(df, 13, most).collect()
        assert len(out) == len(wanted) and {(r.file_id, r.frame_id, r.pts_us): (r.started_us, r.completed_us) for r in out} == wanted
