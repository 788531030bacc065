"""Links of pages, their filters, the link graph and bounded traversal."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions.dom import links_of
from siteloom.functions.url import SKIP_CRAWL, host, is_link, is_skipped, page_key
from siteloom.storage import cut


def page_links(pages: DataFrame) -> DataFrame:
    """``(page_id, url, ord, href, target)`` of every link of every page, decoded and resolved, in order."""
    found = pages.select("page_id", "url", F.posexplode(links_of("url", "html")).alias("ord", "link"))
    return found.select("page_id", "url", "ord", "link.href", "link.target")


def site_links(links: DataFrame, skip: tuple[str, ...] = SKIP_CRAWL) -> DataFrame:
    """Links that a crawl follows: to pages of the same host, without skipped paths."""
    return links.where(is_link("href") & (host("target") == host("url")) & ~is_skipped("target", skip))


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, n_out, n_in)`` over distinct edges ``(src, dst)``."""
    once = edges.select("src", "dst").distinct()
    ends = once.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(once.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").cast("long").alias("n_out"), F.sum("i").cast("long").alias("n_in"))


def frontier(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """``(site, node, depth)``: breadth-first from ``seeds (site, node)`` over ``edges (site, src, dst)``.

    All sites advance together, one level a round; the visited set is a checkpoint, so a
    round reads tables, not the rounds before it. Stops when a level is empty. With
    ``most``, a site stops at so many nodes, by depth, then by name.
    """

    def budgeted(level: DataFrame, visited: DataFrame | None) -> DataFrame:
        if most is None:
            return level
        rank = F.row_number().over(Window.partitionBy("site").orderBy("node"))
        ranked = level.withColumn("_rank", rank)
        if visited is None:
            return ranked.where(F.col("_rank") <= most).drop("_rank")
        held = visited.groupBy("site").agg(F.count("*").alias("_held"))
        return ranked.join(held, "site").where(F.col("_held") + F.col("_rank") <= most).drop("_rank", "_held")

    visited = level = cut(budgeted(seeds.select("site", "node").distinct().withColumn("depth", F.lit(0).cast("long")), None))
    for depth in count(1):
        step = level.join(edges, (edges["site"] == level["site"]) & (edges["src"] == level["node"])).select(level["site"], F.col("dst").alias("node"))
        fresh = step.distinct().join(visited, ["site", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        level = cut(budgeted(fresh, visited))
        if level.isEmpty():
            return visited
        visited = cut(visited.union(level))


def crawl(pages: DataFrame, seeds: DataFrame, most: int, skip: tuple[str, ...] = SKIP_CRAWL) -> DataFrame:
    """``(site, node, depth)`` of the pages that a crawl from ``seeds (url)`` reaches by their own links.

    A node is a page's normal form. Only links within the site to pages that exist are
    followed; pages of one form are one node with the links of all. A site stops at
    ``most`` pages.
    """
    here = pages.select(host("url").alias("site"), page_key("url").alias("node")).distinct()
    found = site_links(page_links(pages), skip).select(host("url").alias("site"), page_key("url").alias("src"), page_key("target").alias("dst")).distinct()
    edges = cut(found.join(here, (found["site"] == here["site"]) & (found["dst"] == here["node"]), "left_semi"))
    start = seeds.select(host("url").alias("site"), page_key("url").alias("node"))
    return frontier(edges, start.join(here, ["site", "node"], "left_semi"), most)


def within_budget(visited: DataFrame, most: int) -> DataFrame:
    """The first ``most`` pages of each site by depth, then by name."""
    rank = F.row_number().over(Window.partitionBy("site").orderBy("depth", "node"))
    return visited.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def batch_pages(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """Exactly the pages whose normal form is among ``urls (url)``, one a form, the least id first."""
    wanted = urls.select(page_key("url").alias("key")).distinct()
    found = pages.withColumn("key", page_key("url")).join(wanted, "key", "left_semi")
    first = F.row_number().over(Window.partitionBy("key").orderBy("page_id"))
    return found.withColumn("_n", first).where("_n = 1").drop("_n")


def section_of(url: str | Column) -> Column:
    """First path segment."""
    return F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"^https?://[^/?#]+/([^/?#]*)", 1)
