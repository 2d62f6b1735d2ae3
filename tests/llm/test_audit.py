"""Whitening and the filter audit against brute force."""

import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from framesift.llm import filter_audit, queries, whitening
from tests.oracle import assert_same, connect

# ---------------------------------------------------------------- whitening


def check_whitened(rows, vectors, components=16):
    """Against exact integers and a plain eigendecomposition; ``vectors`` are (id, entries)."""
    ints = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in ints})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    covariance = centred.T @ centred / n
    values = np.linalg.eigvalsh(covariance)[::-1]
    k = min(components, int((values > 1e-12 * np.trace(covariance)).sum()))
    assert len(rows) == k * len(ints)
    assert sorted((r.vec_id is None, r.vec_id, r.component) for r in rows) == sorted((i is None, i, c) for i, _ in ints for c in range(1, k + 1))
    exact = dict(ints)
    for r in rows:
        assert r.n == n
        assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(exact[r.vec_id], sums))
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(covariance), rel=1e-6)
        assert 0 <= r.identity_error <= 1e-4
    # whitened rows of the fit list have the identity as their covariance, and span what the components span
    by = {}
    for r in rows:
        by.setdefault(exact[r.vec_id], {})[r.component] = r.whitened
    white = np.array([[by[x][c] for c in range(1, k + 1)] for x in fit])
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-6
    # the cross products with the centred rows are the components times the roots of their eigenvalues
    components = (centred.T @ white / n) / np.sqrt(values[:k])
    assert np.abs(covariance @ components - components * values[:k]).max() < 1e-6 * values[0]


def test_op12_matches_brute_force(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pydict()
    check_whitened(queries.op12_whitening(spark, sf_dir).collect(), list(zip(table["vec_id"], table["embedding"])))


def test_op12_awkward_vectors(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.gauss(0, 3) for _ in range(20)]) for i in range(60)]
    vectors += [(60 + i, vectors[0][1]) for i in range(200)]  # a hot vector counts once
    vectors += [(400, None), (401, [1.0] * 19 + [None]), (402, [1.0] * 19 + [float("nan")]), (403, [1.0] * 19 + [float("inf")]), (None, vectors[1][1])]
    df = spark.createDataFrame(vectors + [(500, [1.0, 2.0])], "vec_id bigint, embedding array<double>").withColumns({"_x": F.lit("x"), "n": F.lit(1), "component": F.lit(2)})
    check_whitened(whitening.whiten(df.repartition(7)).collect(), vectors)


def test_op12_few_dimensions_and_nothing(spark):
    schema = "vec_id bigint, embedding array<float>"
    flat = [(i, [float(i), 2.0, -float(i)]) for i in range(9)]
    check_whitened(whitening.whiten(spark.createDataFrame(flat, schema)).collect(), flat)  # one component holds all variance
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []


def test_op12_exact_beyond_64_bits(spark):
    vectors = [(1, [3e9, 1.0]), (2, [-3e9, 5.0]), (3, [1e9, 2.0])]
    ints = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in vectors]
    sums = [sum(c) for c in zip(*ints)]
    exact = [sum((3 * c - s) ** 2 for c, s in zip(x, sums)) for x in ints]
    rows = whitening.whiten(spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")).collect()
    assert {r.vec_id: r.deviation for r in rows} == {i: e if e < 2**63 else None for (i, _), e in zip(vectors, exact)}


# ---------------------------------------------------------------- filter audit


def brute(rows, labels):
    """The report by going through all orders for every row; rows are (id, text, part)."""
    failed = []
    for key, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in rows)
        fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search(r"[#$%&*|]", text) is not None, copy)
        good, toxic = any(k == key and q == 1 for k, q, _ in labels), any(k == key and t == 1 for k, _, t in labels)
        failed.append((part or "", {f for f, x in zip("ABCDE", fails) if x}, good, toxic))
    shapley, report = {}, {}
    parts = {x[0] for x in failed}
    for order in map("".join, itertools.permutations("ABCDE")):
        for step, f in enumerate(order, 1):
            before = set(order[: step - 1])
            for p in parts:
                own = [x for x in failed if x[0] == p]
                gone = [x for x in own if f in x[1] and not x[1] & before]
                report[p, order, step] = [
                    sum(not x[1] & (before | {f}) for x in own), len(gone), sum(f in x[1] and bool(x[1] & before) for x in own), sum(x[1] == {f} for x in own),
                    sum(x[2] for x in gone), sum(x[3] for x in gone),
                ]
                shapley[p, f] = shapley.get((p, f), 0) + len(gone)
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in report.items()}


def report(df):
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(r) for r in df.select(*names).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_op13_matches_sql(spark, sf_dir):
    assert_same(queries.op13_filter_audit(spark, sf_dir), connect(sf_dir), queries.oracle_sql()["op13_filter_audit"])


LABELS = [(1, 1, 0), (2, 0, 1), (4, 1, 1), (4, 0, 0), (7, None, 1)]


def audited(spark, rows, labels=LABELS, parts=3):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"_id": F.lit("x"), "_mask": F.lit(1), "part": F.lit("y"), "quality": F.lit(0)})
    return filter_audit.filter_audit(df.repartition(parts), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_op13_awkward_rows(spark):
    many = " ".join(f"w{i}" for i in range(120))
    rows = [(1, None, None), (2, "", "en"), (3, many, "en"), (4, many, "fr"), (4, many, "fr"), (None, many, "en"), (5, many + " #", "en"), (6, "A B C", ""), (7, "a\x85b c d " * 50, "en"), (8, "ÀÉ" * 9, "de"), (9, "x " * 50_000, "de"), (10, "X\x1cY " * 100, "en")]
    assert report(audited(spark, rows)) == brute(rows, LABELS)
    assert audited(spark, []).collect() == []


def test_op13_copies_over_many_ranges(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "hot text" if i % 3 else f"text {rng.randrange(40)} #", "en" if i % 2 else None) for i in range(600)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert report(audited(spark, rows)) == brute(rows, LABELS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scan_holds_back_little(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(filter_audit, "HELD", 4)
    prints = [1] * 3 + [2] * 20 + [3] * 2 + [4] * 2
    batches = [pa.record_batch({"_id": [i], "_part": ["p"], "_text": [f"t{x}"], "_print": [x]}) for i, x in enumerate(prints)]
    found = [r for b in filter_audit._scan(iter(batches)) for r in b.to_pylist()]
    assert [r["_id"] for r in found] == list(range(len(prints)))
    assert [r["_edge"] is not None for r in found] == [True] * 3 + [True] * 20 + [False] * 2 + [True] * 2
    assert [bool(r["_mask"] & 16) for r in found] == [i > 0 and prints[i] == prints[i - 1] for i in range(len(prints))]
