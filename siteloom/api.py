"""What callers ask for, as functions over the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.url import format_error, trimmed
from siteloom.operators import schedule, versions

#: States in which a site is being worked on.
BUSY = ("pending", "crawling")


def register_sites(sites: DataFrame, asked: DataFrame) -> DataFrame:
    """``(url, status)`` of addresses ``asked (url)``: ``added``, ``exists`` or the reason why not; each once."""
    known = sites.select(trimmed("url").alias("url")).distinct().withColumn("_k", F.lit(True))
    new = asked.select(trimmed("url").alias("url")).distinct().join(known, "url", "left")
    status = F.when(format_error("url").isNotNull(), format_error("url")).when(F.col("_k"), "exists").otherwise("added")
    return new.select("url", status.alias("status"))


def request_recrawl(sites: DataFrame, asked: DataFrame, queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts ``(site, accepted)`` on sites ``(site, status)`` and the queue without the accepted ones."""
    verdicts = asked.select("site").distinct().join(sites, "site").select("site", (~F.col("status").isin(*BUSY)).alias("accepted"))
    return verdicts, schedule.without(queue, verdicts.where("accepted"))


def drop_sites(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of ``gone (site)``."""
    return {name: versions.delete(df, gone, ["site"]) for name, df in tables.items()}


def full_checks(sites: DataFrame, queue: DataFrame, now: Column, most: int) -> DataFrame:
    """``(site, action)`` of due sites: ``crawl`` if ready, else ``reschedule``."""
    taken = schedule.due(queue, now, most).join(sites, "site")
    return taken.select("site", F.when(F.col("status") == "ready", "crawl").otherwise("reschedule").alias("action"))


def light_checks(sites: DataFrame, curated: DataFrame, queue: DataFrame, now: Column, most: int) -> DataFrame:
    """``(site, action)`` of due sites: ``check`` if ready and any curated page ``(site, hash)`` has a
    fingerprint, else why it is only scheduled again."""
    marked = curated.where("hash IS NOT NULL AND hash <> ''").select("site").distinct().withColumn("_m", F.lit(True))
    taken = schedule.due(queue, now, most).join(sites, "site", "left").join(marked, "site", "left")
    ready = F.coalesce(F.col("status") == "ready", F.lit(False))
    action = F.when(~ready, "not_ready").when(F.col("_m"), "check").otherwise("no_curated_pages_with_fingerprints")
    return taken.select("site", action.alias("action"))


def digest_history(stored: DataFrame, site: object) -> DataFrame:
    """Versions of a site's digest, newest first, without their content."""
    return stored.where(F.col("site") == F.lit(site)).drop("content").orderBy(F.desc("version"))


def digest_current(stored: DataFrame) -> DataFrame:
    return versions.latest(stored, "site", [F.desc("version")])


def download(digests: DataFrame, path: str) -> None:
    """Digests as text, a folder a site."""
    digests.select("site", F.col("content").alias("value")).write.mode("overwrite").partitionBy("site").text(path)
