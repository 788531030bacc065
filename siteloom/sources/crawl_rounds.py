"""Crawls of many sites at once, a round for each depth, which go on where they were stopped.

Under ``folder`` a round has two tables: ``level`` (what it asks for) and ``pages`` (what
came). A round deals its level by site over tasks; a task walks each of its sites by name of
the address, a few requests at a time with a pause between them, tries again where a server
is busy, and stops at what the site's budget still allows. Links of the pages, without what
earlier levels held, are the next level. Tables are written whole, so a crawl that is killed
and called again repeats one round at most, and no site is walked by one task from its start.

A page that failed, or that a redirect took off its site, is stored but uses no budget, and
links resolve against the address that answered. Pages that show too little without scripts
are asked for again through the backend ``render``, if one is named.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.conf import CONF
from siteloom.functions.dom import needs_render
from siteloom.functions.url import SKIP_CRAWL, host, page_key
from siteloom.operators.links import page_links, site_links
from siteloom.sources.site_crawl import BACKENDS, Fetched, fetched
from siteloom.storage import exists

LEVEL = "site string, node string"
PAGES = "site string, node string, url string, html string, status int, ok boolean"
#: Answers after which a request is tried again; 0 is none in time.
BUSY = (0, 429, 500, 502, 503, 504)


def patiently(address: str, options: dict) -> Fetched:
    """The answer after as many tries, with growing waits, as ``tries`` and ``wait`` say; rendered if ``render`` is named and needed."""
    fetch = BACKENDS[options.get("backend", "folder")]
    for n in range(int(options.get("tries", 3))):
        if n:
            time.sleep(float(options.get("wait", 1)) * 2 ** (n - 1))
        found = fetched(fetch, address, options)
        if found.status not in BUSY:
            break
    if options.get("render") and found.html and found.status < 400 and needs_render(found.html):
        again = fetched(BACKENDS[options["render"]], found.url, options)
        return again if again.html is not None else found
    return found


def _walk(site: str, nodes: Iterator[str], budget: int, options: dict, pool: ThreadPoolExecutor) -> Iterator[tuple]:
    """Pages of one site in order until ``budget`` of them are right; never more requests at once than could be."""
    at_once, pause = int(options.get("concurrency", 8)), float(options.get("delay", 0.5))
    from urllib.parse import urlsplit

    while budget > 0:
        asked = list(islice(nodes, min(at_once, budget)))
        if not asked:
            return
        for node, found in zip(asked, pool.map(lambda a: patiently(a, options), asked), strict=True):
            ok = found.html is not None and found.status < 400 and urlsplit(found.url).netloc.lower() == site
            budget -= ok
            yield site, node, found.url, found.html, found.status, ok
        time.sleep(pause)


def _fetched(options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["site", "node", "url", "html", "status", "ok"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_()]
        rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("site", "node", "left")), strict=True))
        with ThreadPoolExecutor(int(options.get("concurrency", 8))) as pool:
            held, size = [], 0
            for (site, left), of in groupby(rows, key=lambda r: (r[0], r[2])):
                for page in _walk(site, (r[1] for r in of), left, options, pool):
                    held.append(page)
                    size += len(page[3] or "")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return run


class Crawl:
    """A crawl's tables in ``folder``; ``options`` are those of the backends, and how to ask: ``concurrency``, ``delay``, ``tries``, ``wait``, ``render``."""

    def __init__(self, spark: SparkSession, folder: str, options: dict | None = None, most: int = CONF.max_pages, skip: tuple[str, ...] = SKIP_CRAWL, tasks: int | None = None) -> None:
        self.spark, self.folder, self.options, self.most, self.skip = spark, folder, dict(options or {}), most, skip
        self.tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _has(self, name: str, n: int) -> bool:
        return exists(self.spark, f"{self.folder}/{name}/round={n}/_SUCCESS")

    def _tables(self, name: str, schema: str, upto: int) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/round={n}").withColumn("depth", F.lit(n).cast("long")) for n in range(upto + 1)]
        return reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], f"{schema}, depth long")

    def _write(self, df: DataFrame, name: str, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/round={n}")

    def run(self, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
        """Go on until no site has a link left that it may follow, or for so many rounds; see :meth:`pages`."""
        if not self._has("level", 0):
            self._write(seeds.select(F.lower(host("url")).alias("site"), page_key("url").alias("node")).where("site <> ''").distinct(), "level", 0)
        n = next(i for i in range(1 << 30) if not self._has("pages", i))
        if n and not self._has("level", n):
            self._level(n)
        done = 0
        while (rounds is None or done < rounds) and not self._stored("level", n).isEmpty():
            self._ask(n)
            n, done = n + 1, done + 1
            self._level(n)
        return self.pages()

    def _stored(self, name: str, n: int) -> DataFrame:
        return self.spark.read.schema(LEVEL if name == "level" else PAGES).parquet(f"{self.folder}/{name}/round={n}")

    def _ask(self, n: int) -> None:
        held = self._tables("pages", PAGES, n - 1).where("ok").groupBy("site").agg(F.count("*").alias("held"))
        left = (F.lit(self.most) - F.coalesce("held", F.lit(0))).cast("int").alias("left")
        asked = self._stored("level", n).join(held, "site", "left").select("site", "node", left).where("left > 0")
        dealt = asked.repartition(self.tasks, "site").sortWithinPartitions("site", "node")
        self._write(dealt.mapInArrow(_fetched(self.options), PAGES), "pages", n)

    def _level(self, n: int) -> None:
        """What the links of round ``n - 1`` lead to for the first time."""
        pages = self._stored("pages", n - 1).where("ok").select(F.lit(0).alias("page_id"), "url", "html")
        links = site_links(page_links(pages), self.skip).select(F.lower(host("target")).alias("site"), page_key("target").alias("node")).distinct()
        self._write(links.join(self._tables("level", LEVEL, n - 1), ["site", "node"], "left_anti"), "level", n)

    def pages(self) -> DataFrame:
        """``(site, node, url, html, status, ok, depth)`` of all rounds that are whole."""
        return self._tables("pages", PAGES, next(i for i in range(1 << 30) if not self._has("pages", i)) - 1)
