"""Queries on versions, jobs, schedules, sitemaps and their streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siteloom.functions import timefmt
from siteloom.operators import schedule, versions
from siteloom.plans.base import HOST, ORACLES, query, table
from siteloom.sources import sitemap
from siteloom.sources.site_crawl import save_pages
from siteloom.storage import new_path
from siteloom.streaming import scheduler, state

_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _at(text):
    """An instant in UTC, whatever the session's time zone."""
    return F.lit(text + "Z").cast("timestamp")


def _utc(column):
    """The instant of a clock time that is meant in UTC."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))"))


def _now():
    return _at("2024-01-31 00:00:00")


def _events(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("site"), _utc("ts").alias("ts"), F.col("event_id").alias("id"), "event_type", "value")


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("id"), _utc("o_orderdate").alias("at"), "o_totalprice", "o_orderstatus")


@query("version_next", "SELECT o_custkey AS site, count(*) + 1 AS next_version FROM orders GROUP BY 1")
def version_next(spark, d):
    return versions.next_version(versions.numbered(_orders(spark, d), "site", ["at", "id"]), "site")


@query("version_list", "SELECT o_custkey AS site, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders")
def version_list(spark, d):
    return versions.numbered(_orders(spark, d), "site", ["at", "id"]).select("site", "id", "version")


@query("version_latest", "SELECT site, id FROM (SELECT o_custkey AS site, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def version_latest(spark, d):
    return versions.latest(_orders(spark, d), "site", [F.desc("at"), F.desc("id")]).select("site", "id")


@query("snapshot_latest", "WITH v AS (SELECT *, year(o_orderdate) AS version FROM orders) SELECT o_custkey AS site, version::BIGINT AS version, count(*) AS n FROM v WHERE (o_custkey, version) IN (SELECT o_custkey, max(version) FROM v GROUP BY 1) GROUP BY ALL")
def snapshot_latest(spark, d):
    rows = _orders(spark, d).withColumn("version", F.year("at").cast("long"))
    top = rows.groupBy("site").agg(F.max("version").alias("version"))
    return rows.join(top, ["site", "version"], "left_semi").groupBy("site", "version").agg(F.count("*").alias("n"))


@query("snapshot_append", f"""SELECT {HOST} AS site, v.version, count(*) AS n, max(length(substring(html, 1, 2000))) AS longest FROM pages, (SELECT unnest([1, 2])::BIGINT AS version) v
    WHERE v.version = 1 OR contains(url, '?page=') GROUP BY ALL""")
def snapshot_append(spark, d):
    """All pages as version 1 in a store, then the paged ones again under the next version, read back."""
    rows = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("site"), "url", F.substring("html", 1, 2000).alias("first_paragraph"))
    path = new_path(spark, "snapshots")
    versions.append_snapshot(rows.withColumn("version", F.lit(1).cast("long")), path)
    stored = spark.read.parquet(path)
    again = rows.where(F.col("url").contains("?page=")).join(versions.next_version(stored, "site"), "site").withColumnRenamed("next_version", "version")
    versions.append_snapshot(again, path)
    found = spark.read.parquet(path).groupBy("site", F.col("version").cast("long").alias("version"))
    return found.agg(F.count("*").alias("n"), F.max(F.length("first_paragraph")).cast("long").alias("longest"))


@query("version_upsert", "WITH n AS (SELECT o_custkey AS site, max(o_orderkey) AS id FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT c_custkey AS site, coalesce(n.id, -1) AS id FROM customer LEFT JOIN n ON c_custkey = site UNION SELECT site, id FROM n WHERE site NOT IN (SELECT c_custkey FROM customer)")
def version_upsert(spark, d):
    stored = table(spark, d, "customer").select(F.col("c_custkey").alias("site"), F.lit(-1).cast("long").alias("id"))
    new = _orders(spark, d).where("o_orderstatus = 'O'").groupBy("site").agg(F.max("id").alias("id"))
    return versions.upsert(stored, new, ["site"])


@query("version_delete", "SELECT o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def version_delete(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("site"))
    return versions.delete(_orders(spark, d), gone, ["site"]).select("id")


_JOBS = "j AS (SELECT user_id AS job, ts, CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'queue' END AS kind, value FROM events)"


def _jobs(spark, d):
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").otherwise("queue")
    return _events(spark, d).select(F.col("site").alias("job"), "ts", kind.alias("kind"), F.lit(1).alias("value"))


_STATE = "s AS (SELECT job, max((ts, kind)) AS last, max(CASE WHEN kind = 'start' THEN ts END) AS started, max(CASE WHEN kind IN ('complete', 'fail') THEN ts END) AS ended, count(*) FILTER (kind = 'complete') AS pages FROM j GROUP BY job)"


@query("job_state", f"WITH {_JOBS}, {_STATE} SELECT job, CASE last[2] WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' WHEN 'start' THEN 'running' ELSE 'pending' END AS status, nullif(pages, 0) AS pages FROM s")
def job_state(spark, d):
    return versions.job_states(_jobs(spark, d)).select("job", "status", F.col("pages").cast("long").alias("pages"))


@query("job_latest", "SELECT user_id AS job, epoch_us(max(ts)) AS at FROM events WHERE event_type = 'view' GROUP BY 1")
def job_latest(spark, d):
    return versions.job_states(_jobs(spark, d)).where("started_at IS NOT NULL").select("job", F.unix_micros("started_at").alias("at"))


@query("job_duration_label", f"""WITH {_JOBS}, {_STATE}, x AS (SELECT job, CAST(epoch(date_trunc('second', {_NOW})) AS BIGINT) - CAST(floor(epoch(started)) AS BIGINT) AS d FROM s WHERE started IS NOT NULL)
    SELECT job, CASE WHEN d < 60 THEN d || 's' ELSE (d // 60) || 'm ' || (d % 60) || 's' END AS label FROM x""")
def job_duration_label(spark, d):
    """Running jobs, so that they last until now."""
    jobs = versions.job_states(_jobs(spark, d)).where("started_at IS NOT NULL")
    return jobs.select("job", timefmt.duration("started_at", F.lit(None).cast("timestamp"), _now()).alias("label"))


@query("site_status", "SELECT c_custkey AS site, c_name AS name, count(o_orderkey) AS n_versions, epoch_us(max(o_orderdate)) AS last_updated FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def site_status(spark, d):
    sites = table(spark, d, "customer").select(F.col("c_custkey").alias("site"), F.col("c_name").alias("name"))
    return versions.site_status(sites, _orders(spark, d)).select("site", "name", "n_versions", F.unix_micros("last_updated").alias("last_updated"))


@query("site_search", "SELECT page_id FROM pages WHERE contains(lower(url), 'blog.') OR contains(lower(html), 'blog.')")
def site_search(spark, d):
    return versions.search(table(spark, d, "pages"), "Blog.", ("url", "html")).select("page_id")


@query("relative_time_label", """WITH o AS (SELECT event_id AS id, ts, CAST(epoch(TIMESTAMP '2024-01-30 12:00:00') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
    SELECT id, CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 604800 THEN (s // 86400) || 'd ago' ELSE strftime(ts, '%b %-d') END AS label FROM o""")
def relative_time_label(spark, d):
    return _events(spark, d).select("id", timefmt.ago("ts", _at("2024-01-30 12:00:00")).alias("label"))


_QUEUE = "q AS (SELECT CASE event_type WHEN 'view' THEN 'full' WHEN 'click' THEN 'light' ELSE 'cooldown' END AS queue, user_id AS site, max(ts) AS run_at FROM events WHERE event_type IN ('view', 'click', 'signup') GROUP BY ALL)"


def _queue(spark, d):
    kind = F.when(F.col("event_type") == "view", "full").when(F.col("event_type") == "click", "light").otherwise("cooldown")
    return _events(spark, d).where(F.col("event_type").isin("view", "click", "signup")).groupBy(kind.alias("queue"), "site").agg(F.max("ts").alias("run_at"))


_DUE = "TIMESTAMP '2024-01-30 12:00:00'"


@query("schedule_due_topk", f"WITH {_QUEUE} SELECT site, epoch_us(run_at) AS run_at FROM q WHERE queue = 'full' AND run_at <= {_DUE} ORDER BY q.run_at, site LIMIT 100")
def schedule_due_topk(spark, d):
    """The limit is the operator: a dispatcher takes so many a run."""
    found = schedule.due(_queue(spark, d).where("queue = 'full'"), _at("2024-01-30 12:00:00"), 100)
    return found.select("site", F.unix_micros("run_at").alias("run_at"))


@query("schedule_stats", f"WITH {_QUEUE} SELECT queue, count(*) FILTER (CASE WHEN queue = 'cooldown' THEN run_at >= {_DUE} ELSE run_at <= {_DUE} END) AS n_due, count(*) AS n_total FROM q GROUP BY queue")
def schedule_stats(spark, d):
    return schedule.stats(_queue(spark, d), _at("2024-01-30 12:00:00"))


@query("schedule_cancel", f"WITH {_QUEUE}, t AS (SELECT site FROM q WHERE queue = 'full' AND run_at <= {_DUE} ORDER BY q.run_at, site LIMIT 100) SELECT queue, site FROM q WHERE site NOT IN (SELECT site FROM t)")
def schedule_cancel(spark, d):
    """What is left in all queues once the due sites were taken out of them."""
    queue = _queue(spark, d)
    return schedule.without(queue, schedule.due(queue.where("queue = 'full'"), _at("2024-01-30 12:00:00"), 100)).select("queue", "site")


@query("schedule_next", f"SELECT c_custkey AS site, epoch_us({_NOW} + INTERVAL 1 HOUR * greatest(6, least(168, c_nationkey * 10))) AS run_at FROM customer")
def schedule_next(spark, d):
    sites = table(spark, d, "customer").select(F.col("c_custkey").alias("site"), timefmt.clamped(F.col("c_nationkey") * 10).alias("hours"))
    return schedule.scheduled(sites, _now(), "hours").select("site", F.unix_micros("run_at").alias("run_at"))


_STAGGER = "('0x' || substring(md5({0}::VARCHAR), 1, 8))::BIGINT % {1}"


@query("schedule_stagger", f"SELECT c_custkey AS site, {_STAGGER.format('c_custkey', 301)} AS delay FROM customer")
def schedule_stagger(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("site"), schedule.stagger(F.col("c_custkey"), 300).alias("delay"))


_READY = "r AS (SELECT c_custkey AS site FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY'))"


@query("schedule_seed", f"""WITH {_READY} SELECT 'full' AS queue, site, epoch_us({_NOW} + INTERVAL 24 HOUR) AS run_at FROM r
    UNION ALL SELECT 'light', site, epoch_us({_NOW}) + 1000000 * ({_STAGGER.format('site', 301)}) FROM r""")
def schedule_seed(spark, d):
    """First entries of the ready customers in both queues."""
    status = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "pending").otherwise("ready")
    sites = table(spark, d, "customer").select(F.col("c_custkey").alias("site"), status.alias("status"))
    return schedule.seeded(sites, _now()).select("queue", "site", F.unix_micros("run_at").alias("run_at"))


@query("dispatch_runs", """WITH q AS (SELECT event_id AS site, ts AS run_at, CAST(ceil(epoch_us(ts) / 3600000000.0::DOUBLE) AS BIGINT) AS due FROM events),
    n AS (SELECT *, row_number() OVER (ORDER BY run_at, site) - 1 AS i FROM q), l AS (SELECT *, max(due * 12 - i) OVER (ORDER BY i) + i AS place FROM n)
    SELECT site, place // 12 AS run FROM l""")
def dispatch_runs(spark, d):
    """All events as entries of a queue of which an hourly run takes twelve."""
    queue = _events(spark, d).select(F.col("id").alias("site"), F.col("ts").alias("run_at"))
    return schedule.dispatch_runs(queue, 12, 3600).select("site", "run")


def _checks(spark, d):
    return _events(spark, d).where(F.col("event_type").isin("view", "purchase")).withColumn("changed", F.col("event_type") == "purchase")


_BACKOFF = """WITH c AS (SELECT user_id AS site, ts, event_id AS id, event_type = 'purchase' AS changed FROM events WHERE event_type IN ('view', 'purchase')),
    r AS (SELECT *, sum(changed::INT) OVER (PARTITION BY site ORDER BY ts, id) AS run FROM c),
    k AS (SELECT *, sum((NOT changed)::INT) OVER (PARTITION BY site, run ORDER BY ts, id) AS quiet FROM r)
    SELECT site, id, CAST(least((CASE WHEN run > 0 THEN 6 ELSE 24 END) * power(2, least(quiet, 10)), 168) AS BIGINT) AS hours FROM k"""


@query("backoff_interval", _BACKOFF)
def backoff_interval(spark, d):
    return schedule.backoff(_checks(spark, d)).select("site", "id", "hours")


_COOL = """WITH RECURSIVE e AS (SELECT user_id AS site, ts, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error'),
    r AS (SELECT site, n, id, ts + INTERVAL 2 HOUR AS until, true AS fired FROM e WHERE n = 1
      UNION ALL SELECT e.site, e.n, e.id, CASE WHEN e.ts >= r.until THEN e.ts + INTERVAL 2 HOUR ELSE r.until END, e.ts >= r.until FROM r JOIN e ON e.site = r.site AND e.n = r.n + 1)
    SELECT site, id, fired FROM r"""


@query("cooldown_gate", _COOL)
def cooldown_gate(spark, d):
    return schedule.cooldowns(_events(spark, d).where("event_type = 'error'")).select("site", "id", "fired")


@query("progress_percent_eta", """SELECT event_id AS id, CASE WHEN value > 0 THEN floor(1000 * (event_id % 100) / floor(value)) ELSE 0 END::BIGINT AS permille,
    CASE WHEN event_id % 100 > 0 THEN floor((floor(value) - event_id % 100) * 60.0::DOUBLE / (event_id % 100))::BIGINT END AS eta FROM events WHERE value >= 1""")
def progress_percent_eta(spark, d):
    rows = _events(spark, d).where("value >= 1").withColumn("done", F.col("id") % 100).withColumn("total", F.floor("value"))
    eta = timefmt.eta_seconds("done", "total", F.lit(60.0))
    return rows.select("id", timefmt.permille("done", "total").alias("permille"), F.floor(eta).cast("long").alias("eta"))


_LAST = "SELECT user_id AS site, max_by(event_id, (ts, event_id)) AS id, max(ts) AS last_ts FROM events GROUP BY 1"


@query("progress_latest", f"SELECT site, id FROM ({_LAST})")
def progress_latest(spark, d):
    return schedule.progress(_events(spark, d), _at("2024-01-01 00:00:00")).select("site", "id")


@query("progress_ttl", f"SELECT site, id FROM ({_LAST}) WHERE CAST(floor(epoch(last_ts)) AS BIGINT) + 3600 > CAST(epoch(TIMESTAMP '2024-01-30 22:00:00') AS BIGINT)")
def progress_ttl(spark, d):
    return schedule.progress(_events(spark, d), _at("2024-01-30 22:00:00")).select("site", "id")


@query("progress_steps", "SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'complete' WHEN 'click' THEN 'active' ELSE 'pending' END AS filter FROM events")
def progress_steps(spark, d):
    step = F.when(F.col("event_type") == "view", "complete").when(F.col("event_type") == "click", "filter").otherwise("unknown")
    return _events(spark, d).select("id", timefmt.step_state("FILTER", step).alias("filter"))


def _sitemaps(spark, d):
    """A sitemap a host, of its pages, and an index of them all; dates in the formats that occur."""
    pages = table(spark, d, "pages")
    site = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    date = F.when(F.col("url").contains("?page="), "2024-01-01").when(F.col("url").endswith("#top"), "2024-01-01T00:00:00Z").when(F.col("url").endswith(".html"), "2024-01-01T01:00:00+01:00").otherwise("garbage")
    entry = F.concat(F.lit("<url><loc> "), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit(" </loc><lastmod>"), date, F.lit("</lastmod></url>"))
    head, ns = '<?xml version="1.0" encoding="UTF-8"?>', 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    maps = pages.groupBy(site.alias("site")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("body"))
    one = maps.select(F.concat(F.lit("http://"), "site", F.lit("/sitemap.xml")).alias("address"), F.concat(F.lit(f"{head}<urlset {ns}>"), "body", F.lit("</urlset>")).alias("xml"))
    listed = one.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "address", F.lit("</loc></sitemap>")))), "").alias("body"))
    index = listed.select(F.lit("index").alias("address"), F.concat(F.lit(f"{head}<sitemapindex {ns}><sitemap><loc>index</loc></sitemap>"), "body", F.lit("</sitemapindex>")).alias("xml"))
    return one.union(index)


def _roots(spark):
    return spark.range(1).select(F.lit("index").alias("root"))


@query("sitemap_urls", "SELECT DISTINCT url AS loc FROM pages")
def sitemap_urls(spark, d):
    return sitemap.urls(_sitemaps(spark, d), _roots(spark)).select("loc")


@query("sitemap_lastmod", "SELECT DISTINCT url AS loc, CASE WHEN contains(url, '?page=') OR url LIKE '%#top' OR url LIKE '%.html' THEN epoch_us(TIMESTAMP '2024-01-01') END AS lastmod FROM pages")
def sitemap_lastmod(spark, d):
    return sitemap.urls(_sitemaps(spark, d), _roots(spark)).select("loc", F.unix_micros("lastmod").alias("lastmod"))


@query("sitemap_split", ORACLES["sitemap_lastmod"])
def sitemap_split(spark, d):
    """The same sitemaps as files, which are cut at their entries; their names hold their addresses."""
    folder = new_path(spark, "sitemaps")
    save_pages(_sitemaps(spark, d).select(F.col("address").alias("url"), F.col("xml").alias("html")), folder)
    listed = sitemap.read_split(spark, folder).withColumn("address", sitemap.saved_address())
    return sitemap.reached(listed, _roots(spark)).select("loc", F.unix_micros("lastmod").alias("lastmod"))


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    found = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return found.select(F.col("user_id").alias("site"), _utc("ts").alias("ts"), F.col("event_id").alias("id"), "event_type", "value").withWatermark("ts", "1 hour")


def _drained(stream, mode="append"):
    return state.drained(stream, "s" + uuid.uuid4().hex, mode)


@query("stream_backoff", _BACKOFF)
def stream_backoff(spark, d):
    checks = _stream(spark, d).where("event_type IN ('view', 'purchase')").withColumn("changed", F.col("event_type") == "purchase")
    return _drained(state.backoff_stream(checks)).select("site", "id", "hours")


@query("stream_cooldown", _COOL)
def stream_cooldown(spark, d):
    return _drained(state.cooldown_stream(_stream(spark, d).where("event_type = 'error'"))).select("site", "id", "fired")


@query("stream_progress", f"SELECT site, id FROM ({_LAST})")
def stream_progress(spark, d):
    return _drained(state.progress_stream(_stream(spark, d)), "complete").select("site", "id")


@query("stream_progress_ttl", f"WITH l AS ({_LAST}), w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events) SELECT site, id FROM l, w WHERE last_ts + INTERVAL 1 HOUR < mark")
def stream_progress_ttl(spark, d):
    """Sites whose last event had expired when the stream ended."""
    return _drained(state.expiring_progress_stream(_stream(spark, d))).where("kind = 'expired'").select("site", "id")


@query("stream_monitor", "SELECT user_id AS site, epoch_us(date_trunc('day', ts)) AS day, count(*) AS n_checks, count(*) FILTER (event_type = 'purchase') AS n_changed FROM events WHERE event_type IN ('view', 'purchase') GROUP BY ALL")
def stream_monitor(spark, d):
    checks = _stream(spark, d).where("event_type IN ('view', 'purchase')").withColumn("changed", F.col("event_type") == "purchase")
    return _drained(state.monitor_stream(checks), "complete").select("site", F.unix_micros("day").alias("day"), "n_checks", "n_changed")


def _timed(spark, d, kinds):
    """Events as a stream for the scheduler, and the clock with it: the whole table is one batch of files."""
    schema = table(spark, d, "events").schema
    found = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = found.select(F.col("user_id").cast("string").alias("site"), _utc("ts").alias("ts"), F.col("event_id").alias("id"), kinds.alias("kind"))
    return rows.where("kind IS NOT NULL").select("site", "ts", "id", "kind")


def _stamped(spark, times):
    """The clock's events at given times, a file each, so that the stream meets them one by one."""
    path = new_path(spark, "ticks")
    for n, ts in enumerate(times):
        row = spark.range(1).select(F.lit(scheduler.CLOCK).alias("site"), ts.alias("ts"), F.lit(n).cast("long").alias("id"), F.lit("tick").alias("kind"))
        row.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(scheduler.EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


_START, _END = "TIMESTAMP '2023-12-31 00:00:00'", "TIMESTAMP '2024-03-01 00:00:00'"


@query("stream_schedule", f"""WITH e AS (SELECT user_id AS site, ts, event_id AS id, event_type AS t FROM events WHERE event_type IN ('view', 'purchase', 'error')),
    c AS (SELECT *, t = 'purchase' AS changed FROM e WHERE t <> 'error'),
    r AS (SELECT *, sum(changed::INT) OVER (PARTITION BY site ORDER BY ts, id) AS run FROM c),
    k AS (SELECT *, sum((NOT changed)::INT) OVER (PARTITION BY site, run ORDER BY ts, id) AS quiet FROM r),
    h AS (SELECT site, ts, id, CAST(least((CASE WHEN run > 0 THEN 6 ELSE 24 END) * power(2, least(quiet, 10)), 168) AS BIGINT) AS hours FROM k),
    x AS (SELECT site, ts, id, t, hours FROM e LEFT JOIN h USING (site, ts, id) UNION ALL SELECT DISTINCT site, {_START}, -1::BIGINT, 'seed', NULL FROM e),
    n AS (SELECT *, lead(ts) OVER (PARTITION BY site ORDER BY ts, id) AS later FROM x),
    f AS (SELECT site, 'full' AS queue, ts + INTERVAL 1 HOUR * coalesce(hours, 24) AS run_at, later FROM n WHERE t <> 'error'
      UNION ALL SELECT site, 'light', CASE WHEN t = 'seed' THEN ts + INTERVAL 1 SECOND * ({_STAGGER.format('site', 301)}) ELSE ts + INTERVAL 5 MINUTE END, later FROM n WHERE t <> 'error')
    SELECT site, queue, epoch_us(date_trunc('millisecond', run_at)) AS run_at FROM f WHERE run_at < {_END} AND (later IS NULL OR date_trunc('millisecond', later) >= date_trunc('millisecond', run_at))
    UNION ALL SELECT site, 'rescrape', epoch_us(date_trunc('millisecond', ts)) FROM e WHERE t = 'error'""")
def stream_schedule(spark, d):
    """Users as sites, seeded on the day before; views are quiet checks, purchases changes, errors ask for a crawl (without a cooldown here, which `stream_cooldown` has)."""
    kind = F.when(F.col("event_type") == "view", "unchanged").when(F.col("event_type") == "purchase", "changed").when(F.col("event_type") == "error", "trigger")
    events = _timed(spark, d, kind)
    sites = table(spark, d, "events").where("event_type IN ('view', 'purchase', 'error')").select(F.col("user_id").alias("site"), F.lit("ready").alias("status"))
    seeds = schedule.seeded(sites, _at("2023-12-31 00:00:00")).withColumn("site", F.col("site").cast("string"))
    both = events.union(_stamped(spark, [_at("2024-03-01 00:00:00")])).withWatermark("ts", "0 seconds")
    with state.rocksdb(spark):
        found = state.drained(scheduler.due_stream(both, seeds, cooldown_hours=0), "s" + uuid.uuid4().hex)
    return found.where(F.col("queue") != scheduler.TICK).select(F.col("site").cast("long").alias("site"), "queue", F.unix_micros("run_at").alias("run_at"))


@query("stream_dispatch", """WITH q AS (SELECT event_id AS site, date_trunc('millisecond', ts) AS run_at, CAST(ceil(epoch_us(date_trunc('millisecond', ts)) / 86400000000.0::DOUBLE) AS BIGINT) AS due FROM events),
    n AS (SELECT *, row_number() OVER (ORDER BY run_at, site::VARCHAR) - 1 AS i FROM q), l AS (SELECT *, max(due * 300 - i) OVER (ORDER BY i) + i AS place FROM n)
    SELECT site, place // 300 AS run FROM l""")
def stream_dispatch(spark, d):
    """All events as entries that the scheduler is seeded with, of which a daily run takes three hundred, while the clock comes on in uneven steps."""
    events = table(spark, d, "events")
    seeds = events.select(F.col("event_id").cast("string").alias("site"), F.lit("full").alias("queue"), _utc("ts").alias("run_at"))
    days = 40 + events.count() // 300
    clock = _stamped(spark, [_at(f"2024-01-{n:02d} 00:00:00") for n in (3, 4, 17)] + [F.timestamp_seconds(F.unix_timestamp(_at("2024-01-01 00:00:00")) + 86400 * days)])
    folder = new_path(spark, "dispatch")
    due = scheduler.due_stream(clock.withWatermark("ts", "0 seconds"), seeds)
    with state.rocksdb(spark):
        scheduler.dispatch(due, folder, new_path(spark, "dispatch-state"), {"full": scheduler.Queue(300, 86400)}, None).awaitTermination()
    return scheduler.dispatched(spark, folder).select(F.col("site").cast("long").alias("site"), "run")
