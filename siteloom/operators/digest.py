"""The site digest: rendering, parsing, merging."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.functions.text import LINK
from siteloom.functions.url import site_key
from siteloom.operators.curate import section_rank


def footer(title: Column) -> Column:
    """Fixed value: the closing sentence."""
    return F.concat(F.lit("This document helps AI systems understand "), title, F.lit("'s purpose and offerings."))


def link_line(title: str, url: str, description: str) -> Column:
    some = F.coalesce(F.col(description), F.lit(""))
    return F.concat(F.lit("- ["), F.col(title), F.lit("]("), F.col(url), F.lit(")"), F.when(some != "", F.concat(F.lit(": "), some)).otherwise(""))


def section_blocks(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """``(site, ord, name, block)`` of sections ``(site, ord, name, prose)`` with the links of their pages.

    Pages ``(site, section, title, url, description)`` go by URL, those of one URL by ``ord``
    if there is such a column, else by what their lines say; homepages have no link;
    a section without pages stays, a page without section does not show.
    """
    shown = pages.where(site_key("url") != F.col("site"))
    order = ["url", "ord"] if "ord" in pages.columns else ["url"]
    lines = shown.groupBy("site", F.col("section").alias("name")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, link_line("title", "url", "description").alias("line")))), lambda x: x["line"]), "\n").alias("links")
    )
    joined = sections.join(lines, ["site", "name"], "left")
    some = lambda c, head: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(head), F.col(c), F.lit("\n\n"))).otherwise("")
    block = F.concat(F.lit("## "), F.col("name"), F.lit("\n\n"), some("prose", ""), some("links", "### Links\n\n"))
    return joined.select("site", "ord", "name", block.alias("block"))


def assemble(overviews: DataFrame, sections: DataFrame, pages: DataFrame) -> DataFrame:
    """``(site, content)`` of overviews ``(site, title, tagline, overview)``: standard sections first."""
    blocks = section_blocks(sections, pages).withColumn("rank", section_rank("name"))
    body = blocks.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ord", "block"))), lambda x: x["block"]), "---\n\n").alias("body"))
    some = lambda c, head: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(head), F.col(c), F.lit("\n\n"))).otherwise("")
    text = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), some("tagline", "> "), some("overview", ""), F.lit("---\n\n"), F.coalesce("body", F.lit("")), F.lit("---\n\n"), footer(F.col("title")))
    return overviews.join(body, "site", "left").select("site", text.alias("content"))


def assemble_flat(overviews: DataFrame, pages: DataFrame) -> DataFrame:
    """A digest of pages with categories and no prose; an empty category is ``Other``."""
    named = pages.withColumn("section", F.when(F.coalesce(F.col("section"), F.lit("")) == "", "Other").otherwise(F.col("section")))
    shown = named.where(site_key("url") != F.col("site"))
    sections = shown.groupBy("site", F.col("section").alias("name")).agg(F.min("page_id").alias("ord")).withColumn("prose", F.lit(""))
    return assemble(overviews, sections, shown)


#: What :func:`read_lines` tells of a line.
LINE = T.StructType([T.StructField("n", T.IntegerType()), *(T.StructField(x, T.StringType()) for x in ("line", "s", "kind")), T.StructField("section", T.LongType())])
#: A link line as the plan's expressions see it: ASCII white space, and ends of line of any kind.
_LINK = re.compile(LINK.replace(r"(.*)", "([^\n\r\x85\u2028\u2029]*)").replace("$", "(?=[\r\x85\u2028\u2029]?\\Z)"), re.ASCII)
#: The rest of a title and the address after it, taken for an address: the title held a bracket.
_NO_ADDRESS = re.compile(r"\]\(\w+://", re.ASCII)


def _is_link(s: str) -> bool:
    m = _LINK.search(s)
    return m is not None and not _NO_ADDRESS.search(m[2])


def _whole_link(lines: list[str], trimmed: list[str], n: int) -> tuple[str, int]:
    """The link that starts in line ``n``, as one text, and its last line: its title may hold ends of line."""
    end = n
    if "]" not in trimmed[n] and trimmed[n][1:].lstrip().startswith("["):
        for end in range(n + 1, len(lines)):
            if trimmed[end].startswith(("- ", "## ", "### ", "---")):
                return trimmed[n], n
            if "]" in lines[end]:
                break
    s = "\n".join(lines[n : end + 1]).strip(" ")
    return (s, end) if _is_link(s) else (trimmed[n], n)


def read_lines(content: str) -> list[tuple[int, str, str, str, int]]:
    """Number, line, trimmed line, kind and section of every line of a document, in one pass and a look back.

    The parser's state: a title, a tagline after it, sections, link lists inside them,
    rules, the footer after the last rule that no heading follows, and text, which belongs
    to the overview or to a section. A link whose title holds ends of line is trimmed as a
    whole in its first line; the others have the kind ``more``.
    """
    lines = content.split("\n")
    trimmed = [x.strip(" ") for x in lines]
    never = len(lines)
    title = next((n for n, s in enumerate(trimmed) if s.startswith("# ")), never)
    tagline = next((n for n in range(title + 1, never) if trimmed[n].startswith("> ")), never)
    last = max((n for n, x in enumerate(lines) if "## " in x), default=-1)
    footer = next((n for n in range(max(last, 0), never) if trimmed[n].startswith("---")), never)
    found, section, listing, first_text, overview_end, link_end = [], 0, False, never, never, -1
    for n, (line, s) in enumerate(zip(lines, trimmed, strict=True)):
        head, links = s.startswith("## "), s.lower() == "### links"
        section, listing = section + head, links or listing and not head
        if n <= link_end:
            kind = "more"
        elif n > footer:
            kind = "footer"
        elif n == footer:
            kind = "rule"
        elif not s and n < title:
            kind = "skip"
        elif n == title:
            kind = "title"
        elif n == tagline:
            kind = "tagline"
        elif head:
            kind = "section"
        elif links:
            kind = "links"
        elif listing and section and s.startswith("- "):
            s, link_end = _whole_link(lines, trimmed, n)
            kind = "link" if _is_link(s) else "swallowed"
        else:
            kind = "rule" if s.startswith("---") else "text"
        # The overview starts after the tagline and ends at the first section that follows some text of it.
        if kind == "text" and n > tagline:
            first_text = min(first_text, n)
        if kind == "section" and n > first_text:
            overview_end = min(overview_end, n)
        if kind == "text":
            kind = "overview" if tagline < n < overview_end else "prose" if section and not listing else "lost"
        found.append((n, line, s, kind, section))
    return found


@F.pandas_udf(T.ArrayType(LINE))
def lines_of(content: pd.Series) -> pd.Series:
    """:func:`read_lines` of each document; null for null."""
    return pd.Series([None if x is None else read_lines(x) for x in content], dtype=object)


@F.udtf(returnType=LINE, useArrow=True)
class DigestLines:
    """``SELECT ... FROM docs, LATERAL digest_lines(content)``: a row a line."""

    def eval(self, content: str) -> Iterator[tuple]:
        if content is not None:
            yield from read_lines(content)


def parse_lines(docs: DataFrame, id_col: str = "site", content: str = "content") -> DataFrame:
    """``(id, n, line, s, kind, section)`` of every line of every document; nothing is sorted or shuffled for it."""
    return docs.select(id_col, F.inline(lines_of(content)))


def _lines_of(kind: str) -> Column:
    """The lines of a kind in a group, in order, as one text without white space at its ends."""
    found = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("n", "line"))))
    return F.regexp_replace(F.array_join(F.transform(found, lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")


def parsed_sections(lines: DataFrame, id_col: str = "site") -> DataFrame:
    """``(id, section, name, prose, n_links)`` of each section in order, from one grouping."""
    name = F.max(F.when(F.col("kind") == "section", F.trim(F.substring("s", 4, 1 << 30)))).alias("name")
    found = lines.where("section > 0").groupBy(id_col, "section").agg(name, _lines_of("prose").alias("prose"), F.count_if(F.col("kind") == "link").alias("n_links"))
    return found.where("name IS NOT NULL")


def parsed_links(lines: DataFrame, id_col: str = "site") -> DataFrame:
    """``(id, section, n, title, url, description)`` of each link in order."""
    part = lambda i: F.trim(F.regexp_extract("s", LINK, i))
    return lines.where("kind = 'link'").select(id_col, "section", "n", part(1).alias("title"), part(2).alias("url"), part(3).alias("description"))


def parsed_overviews(lines: DataFrame, id_col: str = "site") -> DataFrame:
    """``(id, title, tagline, overview)``, from one grouping."""
    line = lambda kind, skip: F.coalesce(F.max(F.when(F.col("kind") == kind, F.trim(F.substring("s", skip, 1 << 30)))), F.lit(""))
    return lines.groupBy(id_col).agg(line("title", 3).alias("title"), line("tagline", 3).alias("tagline"), _lines_of("overview").alias("overview"))


def merge(lines: DataFrame, regenerated: DataFrame, unchanged: DataFrame, id_col: str = "site") -> DataFrame:
    """``(id, content)``: sections of a parsed digest in order, with new text where regenerated.

    Regenerated ``(id, name, prose, links)`` replace theirs, ``unchanged (id, name)`` stay,
    others drop out; the tagline line is there even when empty; no rules between sections.
    """
    links = parsed_links(lines, id_col).groupBy(id_col, "section").agg(F.array_sort(F.collect_list(F.struct("n", link_line("title", "url", "description").alias("line")))).alias("x"))
    old = parsed_sections(lines, id_col).join(links, [id_col, "section"], "left").withColumn("old_links", F.array_join(F.transform("x", lambda x: x["line"]), "\n")).drop("x")
    new = regenerated.select(id_col, "name", F.col("prose").alias("new_prose"), F.col("links").alias("new_links"), F.lit(True).alias("again"))
    same = unchanged.select(id_col, "name", F.lit(True).alias("same")).distinct()
    joined = old.join(new, [id_col, "name"], "left").join(same, [id_col, "name"], "left").where("again OR same")
    pick = lambda a, b: F.when(F.col("again"), F.coalesce(F.col(a), F.lit(""))).otherwise(F.coalesce(F.col(b), F.lit("")))
    some = lambda c, head: F.when(c != "", F.concat(F.lit(head), c, F.lit("\n\n"))).otherwise("")
    block = F.concat(F.lit("## "), F.col("name"), F.lit("\n\n"), some(pick("new_prose", "prose"), ""), some(pick("new_links", "old_links"), "### Links\n\n"))
    body = joined.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", block.alias("block")))), lambda x: x["block"]), "").alias("body"))
    heads = parsed_overviews(lines, id_col)
    text = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n> "), F.col("tagline"), F.lit("\n\n"), some(F.col("overview"), ""), F.coalesce("body", F.lit("")), F.lit("---\n\n"), footer(F.col("title")))
    return heads.join(body, id_col, "left").select(id_col, text.alias("content"))


def section_hash(pages: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, hash)``: SHA-256 of the pages' hashes in URL order, '' for a page without."""
    found = pages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("url", F.coalesce("hash", F.lit("")).alias("h")))).alias("x"))
    return found.select(*keys, F.sha2(F.array_join(F.transform("x", lambda x: x["h"]), "|").cast("binary"), 256).alias("hash"))
