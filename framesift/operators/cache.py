"""The detection cache as tables: lookup, misses, upsert, read-through, prefix delete, and replay of a bounded cache.

Null keys are never found and never stored. Repeated keys each get their row. Empty tables give
empty results; in ``upsert``, of rows equal in key, time and side the greatest counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lookup(keys: DataFrame, cached: DataFrame) -> DataFrame:
    """Every key with its cached columns, and whether there was an entry."""
    return keys.join(cached.withColumn("_hit", F.lit(True)), "key", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def misses(keys: DataFrame, cached: DataFrame) -> DataFrame:
    return keys.join(cached.select("key"), "key", "left_anti")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest entry of each key by cached_at; of equally late ones the new table's. Pre-aggregated, so hot keys don't gather."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    others = [c for c in old.columns if c != "key"]
    best = both.groupBy("key").agg(F.max_by(F.struct(*others), F.struct("cached_at", "_side")).alias("_row"))
    return best.select("key", *[F.col(f"_row.{c}").alias(c) for c in others])


class DetectionCache:
    """A table of computed values by key, in a folder that all executors share, that only ever computes what it doesn't hold.

    Every commit is one partition of the table (``commit=<name>``). It is replaced as a whole when
    its job ends, so a commit that failed leaves nothing, and one that is run again (by the same
    name) reads what the others hold, computes the same misses and puts the same rows in the same
    place. Of a key that two commits hold, that of the commit whose name sorts first counts.
    """

    def __init__(self, spark: SparkSession, path: str, values: str):
        """``values`` is the DDL of the columns beside ``key`` (bigint)."""
        self.spark, self.path, self.schema = spark, path, f"key bigint, {values}, commit string"

    def table(self, without: str | None = None) -> DataFrame:
        """key and values of all commits, but for those of the commit ``without``."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], self.schema)
        # the partition's name is pruned before any file is read
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return rows.where(F.col("commit") != without) if without is not None else rows

    def put(self, rows: DataFrame, commit: str) -> None:
        """Store rows (key and values) as one commit, in the place of an earlier run of it; of equal keys the least row stays."""
        names = [c for c in rows.columns if c != "key"]
        once = rows.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(*names)).alias("_row")).select("key", *[F.col(f"_row.{c}").alias(c) for c in names])
        writer = once.withColumn("commit", F.lit(commit)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("commit").parquet(self.path)

    def read_through(self, keys: DataFrame, compute: Callable[[DataFrame], DataFrame], commit: str, override: DataFrame | None = None) -> DataFrame:
        """``keys`` with the values of each and ``source``: cache, override or computed.

        What the table doesn't hold comes from ``override`` (key and values) and else from
        ``compute``, which gets one row of each missing key with the columns of ``keys`` and
        returns key and values; both are stored under ``commit``. A key for which it returns
        nothing has null values and no source, and is asked for again the next time.
        """
        held = self.table(without=commit)
        missing = keys.where("key IS NOT NULL").join(held.select("key"), "key", "left_anti").dropDuplicates(["key"])
        if override is not None:
            given = override.join(missing.select("key"), "key", "left_semi").withColumn("source", F.lit("override"))
            missing = missing.join(override.select("key"), "key", "left_anti")
        found = compute(missing).withColumn("source", F.lit("computed"))
        self.put(found.unionByName(given) if override is not None else found, commit)
        names = [c for c in found.columns if c not in ("key", "source")]
        mine = F.col("commit") == commit
        rows = self.table().select("key", F.struct("commit", F.when(mine, F.col("source")).otherwise("cache").alias("source"), *names).alias("_row"))
        best = rows.groupBy("key").agg(F.min("_row").alias("_row"))
        return keys.join(best, "key", "left").select(*[F.col(c) for c in keys.columns], *[F.col(f"_row.{c}").alias(c) for c in [*names, "source"]])


def without_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    return rows.where(~F.col(column).startswith(prefix))


def replay(accesses: DataFrame, order: list[str], capacity: int) -> DataFrame:
    """file_id, keys (oldest first) and hits of a cache of ``capacity`` entries after the accesses (file_id, key, is_get).

    A get refreshes its key; a set of a key that is there doesn't; a set beyond the capacity evicts
    the oldest. The accesses of one file are one sequence by nature and fold in one row.
    """
    log = accesses.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(*order, "key", "is_get"))).alias("s"))
    start = F.struct(F.slice(F.transform("s", lambda x: x["key"]), 1, 0).alias("keys"), F.lit(0).cast("bigint").alias("hits"))

    def step(state: Column, x: Column) -> Column:
        there = F.array_contains(state["keys"], x["key"])
        refreshed = F.array_append(F.array_remove(state["keys"], x["key"]), x["key"])
        full = F.size(state["keys"]) >= capacity
        added = F.array_append(F.when(full, F.slice(state["keys"], 2, capacity)).otherwise(state["keys"]), x["key"])
        keys = F.when(x["is_get"], F.when(there, refreshed).otherwise(state["keys"])).when(there, state["keys"]).otherwise(added)
        return F.struct(keys.alias("keys"), (state["hits"] + F.when(x["is_get"] & there, 1).otherwise(0)).alias("hits"))

    return log.select("file_id", F.aggregate("s", start, step).alias("r")).select("file_id", "r.keys", "r.hits")
