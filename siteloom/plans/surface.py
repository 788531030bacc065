"""Queries that ask through SQL views and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom import surface
from siteloom.operators import versions
from siteloom.plans.base import ORACLES, query, table
from siteloom.plans.curation import _SITES, _sites
from siteloom.plans.state import _events, _jobs, _orders, _queue

_NOW = "2024-01-30 12:00:00"


def _registered(spark, d):
    """Customers as sites, their orders as digests, events as jobs, progress and queues."""
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("site"), F.col("c_name").alias("name"), F.concat(F.lit("http://"), "c_mktsegment", F.lit(".org/"), "c_custkey").alias("url"))
    digests = versions.numbered(_orders(spark, d), "site", ["at", "id"]).select("site", "version", F.col("o_orderstatus").alias("content"), "at", "id")
    tables = {"sites": names.join(_sites(spark, d), "site"), "digests": digests, "job_events": _jobs(spark, d), "progress_events": _events(spark, d).select("site", "ts", "id"), "queue": _queue(spark, d)}
    surface.register(spark, tables, _NOW)


@query("sql_site_list", ORACLES["site_status"])
def sql_site_list(spark, d):
    _registered(spark, d)
    return spark.sql("SELECT site, name, n_versions, unix_micros(last_updated) AS last_updated FROM site_list")


@query("sql_digests", "SELECT o_custkey AS site, count(*) AS n, count(*)::BIGINT AS newest FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE contains(lower(c_mktsegment), 'build')) GROUP BY 1")
def sql_digests(spark, d):
    """Sites found by a text, and of each its versions: functions joined laterally."""
    _registered(spark, d)
    return spark.sql("SELECT s.site, count(*) AS n, max(v.version) AS newest FROM site_by_text('BUILD') s, LATERAL digests_of(s.site) v GROUP BY s.site")


@query("sql_recrawl", f"WITH {_SITES} SELECT site, status = 'ready' AS accepted FROM s WHERE site IN (SELECT user_id FROM events)")
def sql_recrawl(spark, d):
    _registered(spark, d)
    _events(spark, d).select("site").distinct().createOrReplaceTempView("sites_asked_for")
    return spark.sql("SELECT v.site, v.accepted FROM sites_asked_for a, LATERAL recrawl_verdict(a.site) v")


@query("sql_schedule", ORACLES["schedule_stats"])
def sql_schedule(spark, d):
    _registered(spark, d)
    return spark.sql("SELECT queue, n_due, n_total FROM schedule_totals")


@query("sql_jobs", ORACLES["job_state"])
def sql_jobs(spark, d):
    _registered(spark, d)
    return spark.sql("SELECT job, status, CAST(pages AS BIGINT) AS pages FROM site_jobs")
