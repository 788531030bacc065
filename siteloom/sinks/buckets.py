"""Tables in buckets by key, of which an upsert rewrites those that it touches.

A table is a folder a bucket, and a key's rows are in the bucket of its hash. A rewrite
reads the touched buckets alone, merges, stores the merged rows beside the table, and then
replaces those folders with dynamic partition overwrite; files of other buckets keep their
names. Replacing takes away before it puts in place, so if it is cut off, the stored rows
are put in again with :func:`finish`, and the table is not read before.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.operators import versions
from siteloom.storage import drop_path, exists

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class BucketTable(NamedTuple):
    """Where a table is, its columns, the key that deals rows, and how many buckets it has."""

    spark: SparkSession
    path: str
    schema: str
    key: str = "site"
    buckets: int = 256

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _pending(self) -> str:
        return f"{self.path}.pending"

    def _at(self, path: str) -> DataFrame:
        schema = f"{self.schema}, bucket int"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._at(self.path).drop("bucket")


def rewrite(table: BucketTable, incoming: DataFrame, merge: Merge) -> list[int]:
    """Put ``merge(stored, incoming)`` in place of the buckets that ``incoming`` touches; their numbers.

    Buckets that the merge leaves without rows go.
    """
    finish(table)
    dealt = incoming.withColumn("bucket", table.bucket())
    touched = sorted(r.bucket for r in dealt.select("bucket").distinct().collect())
    if not touched:
        return []
    stored = table._at(table.path).where(F.col("bucket").isin(touched)).drop("bucket")
    merged = merge(stored, incoming).withColumn("bucket", table.bucket())
    pending = table._pending()
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{pending}/rows")
    table.spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{pending}/touched")
    finish(table)
    return touched


def finish(table: BucketTable) -> bool:
    """Put in place what a rewrite has stored and not yet put in; whether there was any."""
    pending, spark = table._pending(), table.spark
    if not exists(spark, f"{pending}/touched/_SUCCESS"):
        drop_path(spark, pending)  # of a merge that was cut off; the table is as before
        return False
    touched = {r.bucket for r in spark.read.schema("bucket int").parquet(f"{pending}/touched").collect()}
    rows = table._at(f"{pending}/rows")
    left = {r.bucket for r in rows.select("bucket").distinct().collect()}
    if left:
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table.path)
    for bucket in sorted(touched - left):
        drop_path(spark, f"{table.path}/bucket={bucket}")
    drop_path(spark, f"{pending}/touched")
    drop_path(spark, pending)
    return True


def upsert(table: BucketTable, incoming: DataFrame, keys: list[str]) -> list[int]:
    """Incoming rows, one for each value of ``keys``, in place of the stored ones."""
    return rewrite(table, incoming.select(*table._at(table.path).drop("bucket").columns), lambda old, new: versions.upsert(old, new, keys))


def replace_keys(table: BucketTable, incoming: DataFrame) -> list[int]:
    """All stored rows of the incoming keys go, the incoming ones come: a curated set of a site as a whole."""
    return upsert(table, incoming, [table.key])


def remove_keys(table: BucketTable, gone: DataFrame) -> list[int]:
    """Rows of the keys of ``gone`` go."""
    return rewrite(table, gone.select(table.key), lambda old, new: versions.delete(old, new.distinct(), [table.key]))


def keep_inventory(table: BucketTable, seen: DataFrame, keys: list[str], first: str = "first_seen", last: str = "last_seen", at: str = "at") -> list[int]:
    """An inventory of ``keys``, each with when it was first and last seen, brought up to ``seen (*keys, at)``."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.unionByName(new.select(*keys, F.col(at).alias(first), F.col(at).alias(last)))
        return both.groupBy(*keys).agg(F.min(first).alias(first), F.max(last).alias(last))

    return rewrite(table, seen, merge)
