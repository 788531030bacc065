"""Sitemaps as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.functions.timefmt import lastmod
from siteloom.storage import cut

_ENTRY = "struct<loc:string,lastmod:string>"
_LISTS = f"struct<url:array<{_ENTRY}>,sitemap:array<{_ENTRY}>>"


def entries(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """``documents`` with ``kind`` (``url`` or ``sitemap``), ``ord``, ``loc``, ``lastmod`` of each entry.

    A document that is no XML has no entries.
    """
    parsed = documents.withColumn("_x", F.from_xml(F.col(xml), _LISTS, {"mode": "PERMISSIVE"}))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_x.{k}").alias("list")) for k in ("url", "sitemap")])
    listed = parsed.withColumn("_k", F.explode(kinds))
    rest = [c for c in documents.columns if c != xml]
    found = listed.select(*rest, F.col("_k.kind").alias("kind"), F.posexplode("_k.list").alias("ord", "e"))
    return found.select(*rest, "kind", "ord", F.trim("e.loc").alias("loc"), F.trim("e.lastmod").alias("lastmod")).where("loc IS NOT NULL AND loc <> ''")


def urls(documents: DataFrame, roots: DataFrame) -> DataFrame:
    """``(root, loc, lastmod)`` reached from ``roots (root)`` over documents ``(address, xml)``, see :func:`reached`."""
    return reached(entries(documents), roots)


def reached(listed: DataFrame, roots: DataFrame) -> DataFrame:
    """``(root, loc, lastmod)`` reached from ``roots (root)`` over entries ``(address, kind, ord, loc, lastmod)``.

    Index files are followed level by level, however deep; each is read once a root, so
    cycles end. Of repeated locations the last one's date counts.
    """
    links = cut(listed)
    seen = level = roots.select("root", F.col("root").alias("address"))
    while True:
        level = level.join(links.where("kind = 'sitemap'"), "address").select("root", F.col("loc").alias("address")).distinct()
        level = cut(level.join(seen, ["root", "address"], "left_anti"))
        if level.isEmpty():
            break
        seen = cut(seen.union(level))
    found = seen.join(links.where("kind = 'url'"), "address")
    last = F.row_number().over(Window.partitionBy("root", "loc").orderBy(F.desc("address"), F.desc("ord")))
    return found.withColumn("_n", last).where("_n = 1").select("root", "loc", lastmod("lastmod").alias("lastmod"))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """``(address, kind, ord, loc, lastmod)`` of the entries of sitemap files, plain or compressed.

    A plain file is cut at the ends of its entries, so several tasks read one large file and
    none holds a document; a compressed one is read by one task as it unpacks. ``ord`` sorts
    as the entries stand in their file. Entries in comments count, prefixed elements do not:
    for such files there is :func:`read`.
    """
    parts = []
    for tag in ("url", "sitemap"):
        pieces = spark.read.option("lineSep", f"</{tag}>").text(path)
        order = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        found = pieces.select(F.col("_metadata.file_path").alias("address"), order.alias("ord"), F.regexp_extract("value", rf"(?s)<{tag}[\s>].*$", 0).alias("x")).where("x <> ''")
        read = found.withColumn("e", F.from_xml(F.concat("x", F.lit(f"</{tag}>")), _ENTRY, {"mode": "PERMISSIVE"}))
        parts.append(read.select("address", F.lit(tag).alias("kind"), "ord", F.trim("e.loc").alias("loc"), F.trim("e.lastmod").alias("lastmod")))
    return parts[0].union(parts[1]).where("loc IS NOT NULL AND loc <> ''")


def saved_address(file: str = "address") -> Column:
    """Of a file that ``site_crawl.save_pages`` has named: the address in its name."""
    return F.url_decode(F.url_decode(F.regexp_extract(file, "[^/]+$", 0)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(address, xml)`` of sitemap files, one document a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("address"), F.col("value").alias("xml"))
