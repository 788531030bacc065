"""Filtering and grouping of pages through batch providers, and what surrounds them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.conf import CONF
from siteloom.functions.text import preview, unfenced
from siteloom.functions.url import inventory_key
from siteloom.operators.providers import ask
from siteloom.operators.replies import Provider, ReplyStore

#: Order of standard sections.
SECTION_ORDER = ("Platform Features", "Solutions", "Integrations", "Resources", "Pricing", "Company", "Other")
#: Kinds of pages that say nothing about a site, by pattern of their path and query.
IRRELEVANT = (
    r"/page/\d+", r"[?&]page=\d+", r"/\d{4}/\d{2}(/|$)", r"/(author|authors|contributor)s?/", r"/(tag|tags|category|categories|search)(/|$|\?)",
    r"/(login|signin|signup|register|account|logout)(/|$|\?)", r"/(privacy|terms|legal|cookies)(/|$|\?)",
)


def substantial(text: str | Column, extra: str | Column | None = None, least: int = CONF.min_page_chars) -> Column:
    """Enough characters in content and preview together."""
    size = lambda c: F.length(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))
    return (size(text) + (size(extra) if extra is not None else 0)) >= least


def relevant(url: str) -> Column:
    return ~F.lower(F.col(url)).rlike("|".join(IRRELEVANT))


def batches(pages: DataFrame, size: int = CONF.relevance_batch, site: str = "site", order: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``pages`` with ``batch``: rows of a site in groups of ``size``, in order."""
    return pages.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(site).orderBy(*order)) - 1) / size).cast("long"))


def one_homepage(pages: DataFrame) -> DataFrame:
    """Of several homepage records of a site only the first stays; it is exempt from filters."""
    n = F.row_number().over(Window.partitionBy("site", "is_homepage").orderBy("page_id"))
    return pages.withColumn("_n", n).where((~F.col("is_homepage")) | (F.col("_n") == 1)).drop("_n")


def rule_provider(batch: pd.DataFrame) -> str:
    """Offline stand-in for a language model: relevance of a batch by path rules, as a JSON reply."""
    import json
    import re

    found = [u for u in batch["url"] if not re.search("|".join(IRRELEVANT), u.lower())]
    return json.dumps({"relevant_urls": found})


def replies(batched: DataFrame, provider: Provider = rule_provider, store: ReplyStore | None = None) -> DataFrame:
    """``(site, batch, reply, error)``: the provider's text for each batch of pages."""
    return ask(batched.select("site", "batch", "page_id", "url"), provider, store=store)


def kept_by_replies(batched: DataFrame, answered: DataFrame) -> DataFrame:
    """Rows whose URL a reply names, compared by key; all rows of a batch without a readable reply."""
    parsed = answered.withColumn("urls", F.from_json(unfenced("reply"), "struct<relevant_urls:array<string>>")["relevant_urls"])
    named = parsed.select("site", "batch", F.transform("urls", lambda u: inventory_key(u)).alias("urls"))
    joined = batched.join(named, ["site", "batch"], "left")
    return joined.where(F.col("urls").isNull() | F.array_contains("urls", inventory_key("url"))).drop("urls")


def grounded(assigned: DataFrame, pages: DataFrame) -> DataFrame:
    """Assigned ``(site, section_ord, section, page_ord, url)`` whose key is a real page, once, in its first section."""
    keyed = assigned.withColumn("key", inventory_key("url"))
    real = pages.select("site", inventory_key("url").alias("key")).distinct()
    first = F.row_number().over(Window.partitionBy("site", "key").orderBy("section_ord", "page_ord"))
    return keyed.join(real, ["site", "key"], "left_semi").withColumn("_n", first).where("_n = 1").drop("_n")


def section_rank(name: str | Column) -> Column:
    """Place of a section in the standard order; others come after."""
    at = F.array_position(F.array(*map(F.lit, SECTION_ORDER)), F.col(name) if isinstance(name, str) else name)
    return F.when(at > 0, at).otherwise(F.lit(999)).cast("long")


def page_entry(number: Column, url: str, title: str, content: str, first_paragraph: str | None = None, h2s: str | None = None) -> Column:
    """One page as a numbered block of a prompt; without content of size, its first paragraph and first h2 headings."""
    text = F.coalesce(F.col(content), F.lit(""))
    para = F.substring(F.coalesce(F.col(first_paragraph), F.lit("")), 1, 200) if first_paragraph else F.lit("")
    heads = F.slice(F.coalesce(F.col(h2s), F.array().cast("array<string>")), 1, 5) if h2s else F.array().cast("array<string>")
    shown = F.when(para != "", F.concat(F.lit("   Preview: "), para, F.lit("...\n"))).otherwise("")
    listed = F.when(F.size(heads) > 0, F.concat(F.lit("   Sections: "), F.array_join(heads, ", "), F.lit("\n"))).otherwise("")
    none = (text == "") & (para == "") & (F.size(heads) == 0)
    body = F.when(F.length(F.trim(text)) > 50, F.concat(F.lit("   Content:\n"), preview(text, 2000), F.lit("\n"))).when(none, "   Content: [EMPTY PAGE - NO CONTENT]\n").otherwise(F.concat(shown, listed))
    name = F.when(F.coalesce(F.col(title), F.lit("")) == "", "Untitled").otherwise(F.col(title))
    return F.concat(number.cast("string"), F.lit(". URL: "), F.col(url), F.lit("\n   Title: "), name, F.lit("\n"), body)


def change_entry(number: Column, url: str, old: str, new: str) -> Column:
    """One change as a numbered block of a prompt."""
    side = lambda c, none: F.when(F.coalesce(F.col(c), F.lit("")) == "", none).otherwise(preview(c, 800))
    return F.concat(
        number.cast("string"), F.lit(". URL: "), F.col(url), F.lit("\n   PREVIOUS CONTENT:\n"), side(old, "(no previous content)"),
        F.lit("\n\n   NEW CONTENT:\n"), side(new, "(no new content)"), F.lit("\n"),
    )


def prompts(entries: DataFrame, between: str = "\n") -> DataFrame:
    """``(site, batch, prompt)``: entries ``(site, batch, n, entry)`` in order."""
    listed = entries.groupBy("site", "batch").agg(F.array_sort(F.collect_list(F.struct("n", "entry"))).alias("found"))
    return listed.select("site", "batch", F.array_join(F.transform("found", lambda x: x["entry"]), between).alias("prompt"))
