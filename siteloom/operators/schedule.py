"""Scheduling state in batch form: due work, backoff, cooldowns, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.conf import CONF


def scheduled(sites: DataFrame, now: Column, hours: str) -> DataFrame:
    """``sites`` with ``run_at``, ``hours`` from ``now``."""
    return sites.withColumn("run_at", F.timestamp_seconds(F.unix_timestamp(now) + F.col(hours) * 3600))


def due(queue: DataFrame, now: Column, most: int) -> DataFrame:
    """The ``most`` earliest entries of ``queue (site, run_at)`` that are due, ties by site."""
    return queue.where(F.col("run_at") <= now).orderBy("run_at", "site").limit(most)


def without(queue: DataFrame, taken: DataFrame) -> DataFrame:
    """The queue after ``taken`` was popped or cancelled."""
    return queue.join(taken.select("site"), "site", "left_anti")


def stats(queue: DataFrame, now: Column) -> DataFrame:
    """``(queue, n_due, n_total)`` of ``(queue, site, run_at)``; a cooldown counts while it lasts."""
    late = F.when(F.col("queue") == "cooldown", F.col("run_at") >= now).otherwise(F.col("run_at") <= now)
    return queue.groupBy("queue").agg(F.count_if(late).alias("n_due"), F.count("*").alias("n_total"))


def stagger(site: Column, seconds: int) -> Column:
    """A spread of first runs over an interval, the same on every run."""
    return F.pmod(F.conv(F.substring(F.md5(site.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(seconds + 1))


def seeded(sites: DataFrame, now: Column, hours: int = CONF.interval_hours, light_seconds: int = CONF.light_interval_seconds) -> DataFrame:
    """``(queue, site, run_at)``: first entries of all ready sites ``(site, status)`` in both queues.

    Full checks are due after the default interval, light ones at a staggered time within theirs.
    """
    ready = sites.where("status = 'ready'").select("site").distinct()
    start = F.unix_timestamp(now)
    full = ready.select(F.lit("full").alias("queue"), "site", F.timestamp_seconds(start + hours * 3600).alias("run_at"))
    return full.union(ready.select(F.lit("light"), "site", F.timestamp_seconds(start + stagger(F.col("site"), light_seconds))))


def dispatch_runs(queue: DataFrame, most: int = CONF.light_checks_per_run, every: int = CONF.light_run_seconds, first: int | None = None) -> DataFrame:
    """``queue (site, run_at)`` with ``run``: the dispatcher's run, counted from the epoch, that takes each entry.

    A run comes every so many seconds, from run ``first`` on, and takes the ``most``
    earliest entries that are due, ties by site. In closed form: an entry's place in line
    is its number plus the largest lead that any run up to its own has over the line before
    it. Windows go over runs, and over the entries that fall due in one of them.
    """
    due = F.ceil(F.unix_micros("run_at") / (every * 1_000_000)).cast("long")
    placed = queue.withColumn("_due", due if first is None else F.greatest(due, F.lit(first)))
    runs = placed.groupBy("_due").agg(F.count("*").alias("_n"))
    past = Window.orderBy("_due").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.withColumn("_before", F.sum("_n").over(past) - F.col("_n"))
    runs = runs.withColumn("_lead", F.max(F.col("_due") * most - F.col("_before")).over(past)).drop("_n")
    number = F.row_number().over(Window.partitionBy("_due").orderBy("run_at", "site")) - 1
    joined = placed.withColumn("_r", number).join(runs, "_due")
    return joined.select(*queue.columns, F.floor((F.col("_lead") + F.col("_before") + F.col("_r")) / most).cast("long").alias("run"))


def runs_until(queue: DataFrame, first: int, last: int, most: int, every: int) -> DataFrame:
    """``queue`` with the ``run`` between ``first`` and ``last`` that takes each entry; null where it has to wait."""
    run = dispatch_runs(queue, most, every, first)
    return run.withColumn("run", F.when(F.col("run") <= last, F.col("run")))


def backoff(checks: DataFrame) -> DataFrame:
    """``checks (site, ts, id, changed)`` with ``hours`` until the next check.

    A change resets the interval to the least, each quiet check doubles it up to the
    most; a site starts at the default. In closed form: quiet checks since the last
    change, counted over each site's history.
    """
    past = Window.partitionBy("site").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    runs = checks.withColumn("_run", F.sum(F.col("changed").cast("long")).over(past))
    quiet = F.sum((~F.col("changed")).cast("long")).over(Window.partitionBy("site", "_run").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0))
    first = F.when(F.col("_run") > 0, CONF.min_interval_hours).otherwise(CONF.interval_hours)
    doubled = first * F.pow(F.lit(2.0), F.least(quiet, F.lit(10)))
    return runs.withColumn("hours", F.least(doubled, F.lit(float(CONF.max_interval_hours))).cast("long")).drop("_run")


def cooldowns(triggers: DataFrame, hours: int = CONF.cooldown_hours) -> DataFrame:
    """``(site, ts, fired)``: whether each trigger fires, given that a fired one blocks for ``hours``.

    A trigger at the very end of a cooldown fires. Greedy by nature, so a fold over each
    site's sorted triggers, all in one expression.
    """
    span = hours * 3_600_000_000
    listed = triggers.groupBy("site").agg(F.array_sort(F.collect_list(F.struct(F.unix_micros("ts").alias("at"), F.col("id")))).alias("x"))
    folded = F.expr(
        f"""aggregate(x, struct(cast(null AS bigint) AS until, cast(array() AS array<struct<at:bigint,id:bigint,fired:boolean>>) AS done),
        (a, t) -> struct(CASE WHEN a.until IS NULL OR t.at >= a.until THEN t.at + {span}L ELSE a.until END AS until,
          array_append(a.done, named_struct('at', t.at, 'id', t.id, 'fired', a.until IS NULL OR t.at >= a.until)) AS done), a -> a.done)"""
    )
    return listed.select("site", F.explode(folded).alias("t")).select("site", F.timestamp_micros("t.at").alias("ts"), F.col("t.id").alias("id"), F.col("t.fired").alias("fired"))


def progress(events: DataFrame, now: Column, ttl: int = CONF.progress_ttl_seconds) -> DataFrame:
    """The last progress ``(site, ts, id, ...)`` of each site that is younger than ``ttl`` seconds."""
    last = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("ts"), F.desc("id")))
    fresh = F.unix_timestamp("ts") + ttl > F.unix_timestamp(now)
    return events.withColumn("_n", last).where("_n = 1").where(fresh).drop("_n")


def cooldown_left(triggered: DataFrame, now: Column, hours: int = CONF.cooldown_hours) -> DataFrame:
    """``triggered (site, at)`` with the ``seconds`` that its cooldown still lasts; 0 once over."""
    left = F.unix_timestamp("at") + hours * 3600 - F.unix_timestamp(now)
    return triggered.withColumn("seconds", F.greatest(F.lit(0), left))
