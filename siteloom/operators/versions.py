"""Stored tables: snapshots, versions, upserts, deletes, jobs and their views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions.url import inventory_key


def next_version(stored: DataFrame, key: str, version: str = "version", base: int = 0) -> DataFrame:
    """``(key, next_version)``: one more than the largest, ``base`` counting as the one before the first."""
    return stored.groupBy(key).agg((F.coalesce(F.max(version), F.lit(base)) + 1).cast("long").alias("next_version"))


def numbered(rows: DataFrame, key: str, order: list[str], base: DataFrame | None = None) -> DataFrame:
    """``rows`` with consecutive versions by ``order``, after the largest of ``base (key, top)``."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")
    if base is None:
        return rows.withColumn("version", n)
    return rows.join(base, key, "left").withColumn("version", n + F.coalesce("top", F.lit(0))).drop("top")


def latest(rows: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with those of ``incoming`` in place of theirs or added; one incoming row a key."""
    return stored.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def delete(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(gone.select(*keys), keys, "left_anti")


def selective_update(curated: DataFrame, removed: DataFrame, changed: DataFrame) -> DataFrame:
    """Curated ``(site, url, description, hash)`` without removed ``(site, url)`` and with changed
    ``(site, url, description, hash)`` rows' new values, all by inventory key."""
    key = inventory_key("url")
    keyed = curated.withColumn("_k", key).join(removed.select("site", key.alias("_k")).distinct(), ["site", "_k"], "left_anti")
    new = changed.select("site", key.alias("_k"), F.col("description").alias("_d"), F.col("hash").alias("_h"))
    joined = keyed.join(new, ["site", "_k"], "left")
    return joined.select("site", "url", F.coalesce("_d", "description").alias("description"), F.coalesce("_h", "hash").alias("hash"))


def updated_sections(sections: DataFrame, regenerated: DataFrame, gone: DataFrame) -> DataFrame:
    """``sections (site, name, description)`` with the text of ``regenerated`` ones and without ``gone (site, name)``."""
    new = regenerated.select("site", "name", F.col("description").alias("_d"))
    kept = delete(sections, gone, ["site", "name"]).join(new, ["site", "name"], "left")
    return kept.select("site", "name", F.coalesce("_d", "description").alias("description"))


def without_sections(curated: DataFrame, gone: DataFrame) -> DataFrame:
    """``curated (site, category, ...)`` without the pages of ``gone (site, name)``."""
    return delete(curated, gone.select("site", F.col("name").alias("category")), ["site", "category"])


def replace_curated(assigned: DataFrame) -> DataFrame:
    """Assigned ``(site, section_ord, page_ord, url, ...)`` rows, each URL in the first section that lists it."""
    first = F.row_number().over(Window.partitionBy("site", "url").orderBy("section_ord", "page_ord"))
    return assigned.withColumn("_n", first).where("_n = 1").drop("_n")


def append_snapshot(pages: DataFrame, path: str) -> None:
    """Append pages with their version; readers prune by it."""
    pages.write.mode("append").partitionBy("version").parquet(path)


def job_states(events: DataFrame) -> DataFrame:
    """``(job, status, started_at, ended_at, pages)``: events ``(job, ts, kind, value)`` folded to the last state.

    Start, complete and fail are kinds; the latest event decides, ties by kind.
    """
    last = F.max(F.struct("ts", "kind"))["kind"]
    status = F.when(last == "complete", "completed").when(last == "fail", "failed").when(last == "start", "running").otherwise("pending")
    at = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.col("ts")))
    return events.groupBy("job").agg(status.alias("status"), at("start").alias("started_at"), at("complete", "fail").alias("ended_at"), F.sum(F.when(F.col("kind") == "complete", F.col("value"))).alias("pages"))


def site_status(sites: DataFrame, versions: DataFrame) -> DataFrame:
    """``sites (site, ...)`` with ``n_versions`` and ``last_updated`` of ``versions (site, at)``; null without any."""
    found = versions.groupBy("site").agg(F.count("*").alias("n_versions"), F.max("at").alias("last_updated"))
    return sites.join(found, "site", "left").withColumn("n_versions", F.coalesce("n_versions", F.lit(0)))


def search(sites: DataFrame, text: str, columns: tuple[str, ...]) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.col(c)).contains(text.lower())
    return sites.where(hit)
