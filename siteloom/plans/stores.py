"""Queries on sinks: appends with versions, and tables of which an upsert rewrites the buckets it touches."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.plans.base import ORACLES, new_snapshot, old_snapshot, query, table
from siteloom.plans.state import _orders
from siteloom.sinks import buckets, version_log
from siteloom.sinks.buckets import BucketTable
from siteloom.storage import new_path

_AT, _AFTER = "2024-01-01", "2024-01-31"


@query("version_append", "SELECT o_custkey AS site, o_orderkey AS id, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS version FROM orders")
def version_append(spark, d):
    """A customer's orders as versions: all of a status are appended in one transaction, status by status."""
    path, rows = new_path(spark, "version-log"), _orders(spark, d)
    for status in sorted(r[0] for r in rows.select("o_orderstatus").distinct().collect()):
        version_log.append(rows.where(F.col("o_orderstatus") == status).select("site", "id"), path)
    return version_log.with_versions(version_log.committed(spark, path, "site long, id long")).select("site", "id", "version")


@query("version_append_latest", """WITH v AS (SELECT o_custkey AS site, o_orderkey AS id, o_orderstatus = 'P' AS again FROM orders)
    SELECT site, id FROM v WHERE again OR site NOT IN (SELECT site FROM v WHERE again)""")
def version_append_latest(spark, d):
    """What each customer's last transaction holds, where those with status P come in a second one."""
    path, rows = new_path(spark, "version-log"), _orders(spark, d)
    for some in (rows.where("o_orderstatus <> 'P'"), rows.where("o_orderstatus = 'P'")):
        version_log.append(some.select("site", "id"), path)
    return version_log.latest(version_log.committed(spark, path, "site long, id long")).select("site", "id")


def _table(spark, tag, schema):
    return BucketTable(spark, new_path(spark, tag), schema, buckets=16)


@query("bucket_upsert", ORACLES["version_upsert"])
def bucket_upsert(spark, d):
    """Customers as stored overviews, and their last open order as the new one, in buckets."""
    stored = _table(spark, "overviews", "site long, id long")
    buckets.upsert(stored, table(spark, d, "customer").select(F.col("c_custkey").alias("site"), F.lit(-1).cast("long").alias("id")), ["site"])
    buckets.upsert(stored, _orders(spark, d).where("o_orderstatus = 'O'").groupBy("site").agg(F.max("id").alias("id")), ["site"])
    return stored.read().select("site", "id")


@query("bucket_replace", """SELECT o_custkey AS site, o_orderkey AS id FROM orders WHERE o_custkey % 50 <> 3 OR o_orderstatus = 'O'
    OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def bucket_replace(spark, d):
    """The sets of some customers are replaced as a whole by their open orders; other buckets stay as they are."""
    stored, rows = _table(spark, "curated", "site long, id long"), _orders(spark, d).select("site", "id", "o_orderstatus")
    buckets.replace_keys(stored, rows)
    buckets.replace_keys(stored, rows.where("site % 50 = 3 AND o_orderstatus = 'O'"))
    return stored.read().select("site", "id")


@query("bucket_remove", ORACLES["version_delete"])
def bucket_remove(spark, d):
    stored = _table(spark, "removed", "site long, id long")
    buckets.replace_keys(stored, _orders(spark, d))
    buckets.remove_keys(stored, table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("site")))
    return stored.read().select("id")


@query("bucket_inventory", ORACLES["inventory_upsert"])
def bucket_inventory(spark, d):
    """The inventory of both snapshots, one after the other."""
    stored = _table(spark, "inventory", "site string, key string, first_seen timestamp, last_seen timestamp")
    for pages, at in ((old_snapshot(spark, d), _AT), (new_snapshot(spark, d), _AFTER)):
        seen = pages.select("site", "key").distinct().withColumn("at", F.lit(at + " 00:00:00Z").cast("timestamp"))
        buckets.keep_inventory(stored, seen, ["site", "key"])
    return stored.read().select("site", "key", F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("last_seen").alias("last_seen"))
