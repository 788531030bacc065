"""The calls of the engine for SQL: views of its tables, and functions that take an argument.

``register`` makes temporary views over the tables that it is given and functions on them,
so that what callers ask can be asked in SQL, with predicates and columns pushed into the
tables. Time is an argument of the views' maker, as everywhere.

=====================  =====================================================================
``site_list``          sites with the number and time of their digests
``site_jobs``          each job's last state
``site_progress``      progress that has not expired
``digest_current``     each site's last digest
``digest_list``        digests without their content
``schedule_due``       what is due, with its place in its queue
``schedule_totals``    due and waiting entries a queue
``site_by_text(t)``    sites whose name or address holds a text
``digests_of(s)``      versions of one site, newest first by ``version``
``digest_of(s, v)``    one version
``address_error(u)``   why an address is no site's, or null
``register_verdict(u)``  ``added``, ``exists`` or the reason why not
``recrawl_verdict(s)`` whether a crawl of a site is accepted; no row for an unknown site
=====================  =====================================================================
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom import api
from siteloom.functions.url import DOMAIN
from siteloom.operators import digest, schedule, versions

#: What each table has at least.
TABLES = {
    "sites": ("site", "name", "url", "status"),
    "digests": ("site", "version", "content", "at"),
    "job_events": ("job", "ts", "kind", "value"),
    "progress_events": ("site", "ts", "id"),
    "queue": ("queue", "site", "run_at"),
}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession, tables: Mapping[str, DataFrame], now: str) -> None:
    """Make the views and functions of those of :data:`TABLES` that are given; ``now`` is a time in UTC as text."""
    for name, df in tables.items():
        if missing := [c for c in TABLES[name] if c not in df.columns]:
            raise ValueError(f"{name} lacks {', '.join(missing)}")
    at = F.lit(now + "Z").cast("timestamp")
    views: dict[str, DataFrame] = {}
    if "sites" in tables:
        sites = tables["sites"]
        views["site_all"] = sites
        if "digests" in tables:
            views["site_list"] = versions.site_status(sites, tables["digests"].select("site", "at"))
    if "digests" in tables:
        digests = tables["digests"]
        views |= {"digest_all": digests, "digest_current": api.digest_current(digests), "digest_list": digests.drop("content")}
    if "job_events" in tables:
        views["site_jobs"] = versions.job_states(tables["job_events"])
    if "progress_events" in tables:
        views["site_progress"] = schedule.progress(tables["progress_events"], at)
    if "queue" in tables:
        late = tables["queue"].where((F.col("run_at") <= at) & (F.col("queue") != "cooldown"))
        views["schedule_due"] = late.withColumn("place", F.row_number().over(Window.partitionBy("queue").orderBy("run_at", "site")))
        views["schedule_totals"] = schedule.stats(tables["queue"], at)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    _functions(spark, tables)
    spark.udtf.register("digest_lines", digest.DigestLines)


def _functions(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    kind = lambda name, column: tables[name].schema[column].dataType.simpleString()
    error = _format_error_sql()
    made = {"address_error": ("(u STRING) RETURNS STRING", f"({error})")}
    if "sites" in tables:
        site = kind("sites", "site")
        listed = f"site {site}, name STRING, url STRING, status STRING"
        made["site_by_text"] = (f"(t STRING) RETURNS TABLE({listed})", "SELECT site, name, url, status FROM site_all WHERE contains(lower(name), lower(t)) OR contains(lower(url), lower(t))")
        busy = ", ".join(map(_quoted, api.BUSY))
        made["recrawl_verdict"] = (f"(s {site}) RETURNS TABLE(site {site}, accepted BOOLEAN)", f"SELECT site, status NOT IN ({busy}) FROM site_all WHERE site_all.site = s")
        verdict = "CASE WHEN address_error(u) IS NOT NULL THEN address_error(u) WHEN count(*) > 0 THEN 'exists' ELSE 'added' END"
        made["register_verdict"] = ("(u STRING) RETURNS TABLE(url STRING, verdict STRING)", f"SELECT rtrim('/', u), {verdict} FROM site_all WHERE rtrim('/', site_all.url) = rtrim('/', u)")
    if "digests" in tables:
        site, version, time = (kind("digests", c) for c in ("site", "version", "at"))
        made["digests_of"] = (f"(s {site}) RETURNS TABLE(site {site}, version {version}, at {time})", "SELECT site, version, at FROM digest_all WHERE digest_all.site = s ORDER BY version DESC")
        made["digest_of"] = (f"(s {site}, v {version}) RETURNS TABLE(site {site}, version {version}, content STRING)", "SELECT site, version, content FROM digest_all WHERE digest_all.site = s AND digest_all.version = v")
    for name, (head, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{head} RETURN {body}")


def _format_error_sql() -> str:
    """The expression of ``functions.url.format_error`` as SQL text, for the argument ``u``."""
    scheme = r"lower(regexp_extract(u, r'^([A-Za-z][A-Za-z0-9+.\-]*):', 1))"
    netloc = r"regexp_extract(u, r'^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"
    domain = f"regexp_replace(lower({netloc}), ':.*$', '')"
    return f"""CASE WHEN {scheme} NOT IN ('http', 'https') THEN 'URL must use http:// or https://' WHEN {netloc} = '' THEN 'URL must include a domain name'
    WHEN NOT ({domain} RLIKE r'{DOMAIN}' OR {domain} = 'localhost') THEN 'Invalid domain name' END"""
