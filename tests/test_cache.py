"""The read-through cache: computes only what it doesn't hold, once, and a commit that is run again changes nothing."""

import pytest
from pyspark.sql import functions as F

from framesift.operators.cache import DetectionCache


def counted(spark):
    """A computation and a counter of the rows that it was given."""
    count = spark.sparkContext.accumulator(0)

    def compute(missing):
        def run(batches):
            for batch in batches:
                count.add(batch.num_rows)
                yield batch

        return missing.select("key").mapInArrow(run, "key bigint").select("key", (F.col("key") * 10).alias("n"))

    return compute, count


def rows_of(df):
    return sorted(((r.key is None, r.key or 0), r.n, r.source) for r in df.collect())


def test_second_run_computes_nothing(spark, tmp_path):
    cache = DetectionCache(spark, f"file://{tmp_path}/cache", "n bigint, source string")
    keys = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "key bigint")
    compute, count = counted(spark)
    wanted = lambda source: [((False, k), k * 10, source) for k in (1, 2, 2, 3)] + [((True, 0), None, None)]
    assert rows_of(cache.read_through(keys, compute, "a")) == wanted("computed")
    assert count.value == 3
    assert rows_of(cache.read_through(keys, compute, "b")) == wanted("cache")
    assert count.value == 3
    assert rows_of(cache.read_through(keys.limit(0), compute, "c")) == []
    more = spark.createDataFrame([(3,), (4,)], "key bigint")
    assert rows_of(cache.read_through(more, compute, "d")) == [((False, 3), 30, "cache"), ((False, 4), 40, "computed")]
    assert count.value == 4


def test_retried_commit_changes_nothing(spark, tmp_path):
    cache = DetectionCache(spark, f"file://{tmp_path}/cache", "n bigint, source string")
    compute, _ = counted(spark)
    cache.put(spark.createDataFrame([(1, 7, "computed"), (1, 9, "computed")], "key bigint, n bigint, source string"), "given")
    keys = spark.createDataFrame([(1,), (5,)], "key bigint")
    before = rows_of(cache.read_through(keys, compute, "x"))
    table = sorted(map(tuple, cache.table().collect()))
    assert rows_of(cache.read_through(keys, compute, "x")) == before == [((False, 1), 7, "cache"), ((False, 5), 50, "computed")]
    assert sorted(map(tuple, cache.table().collect())) == table and len(table) == 2


def test_failed_commit_leaves_nothing(spark, tmp_path):
    cache = DetectionCache(spark, f"file://{tmp_path}/cache", "n bigint, source string")
    keys = spark.createDataFrame([(k,) for k in range(100)], "key bigint")
    compute, count = counted(spark)

    def broken(missing):
        return compute(missing).withColumn("n", F.when(F.col("key") == 57, F.raise_error(F.lit("no model"))).otherwise(F.col("n")).cast("bigint"))

    with pytest.raises(Exception, match="no model"):
        cache.read_through(keys, broken, "x")
    assert cache.table().count() == 0
    override = spark.createDataFrame([(57, 1), (500, 2)], "key bigint, n bigint")
    found = cache.read_through(keys, compute, "x", override).groupBy("source").count()
    assert {r.source: r["count"] for r in found.collect()} == {"computed": 99, "override": 1}
