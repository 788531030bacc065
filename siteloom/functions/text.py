"""Text expressions: normal form, hashes, previews, JSON replies, document lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom.functions.url import _c

#: Fixed value: a link line of a digest. The address may hold brackets and ends at the first ")" with a description or nothing after it.
LINK = r"^-\s*\[([^\]]+)\]\(([^)\n][^\n]*?)\)(?::\s*(.*))?$"


def normal(text: str | Column) -> Column:
    """White space of any script to single spaces, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " ")))


def content_hash(text: str | Column) -> Column:
    """SHA-256 in hex; '' stays ''."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.when(t != "", F.sha2(t.cast("binary"), 256)).otherwise("")


def short_mark(text: str | Column) -> Column:
    """First eight hex digits of the MD5, a name for a prompt or reply."""
    return F.substring(F.md5(_c(text).cast("binary")), 1, 8)


def preview(text: str | Column, most: int) -> Column:
    """The first ``most`` characters, trimmed, with an ellipsis if any are left out."""
    t = _c(text)
    cut = F.trim(F.substring(t, 1, most))
    return F.when(F.length(t) > most, F.concat(cut, F.lit("..."))).otherwise(cut)


def unfenced(text: str | Column) -> Column:
    """A JSON reply without the code fence around it."""
    t = F.trim(_c(text))
    opened = F.when(t.startswith("```"), F.regexp_replace(t, r"^[^\n]*\n", "")).otherwise(t)
    return F.trim(F.regexp_replace(opened, r"\s*```\s*$", ""))


def line_kind(line: str | Column) -> Column:
    """Role of a document line by its first characters."""
    c = _c(line)
    bare = F.trim(c)
    return (
        F.when(c.startswith("# "), "h1")
        .when(c.startswith("### "), "h3")
        .when(c.startswith("## "), "h2")
        .when(bare == "---", "rule")
        .when(c.startswith("> "), "quote")
        .when(c.rlike(r"^- \[[^\]]+\]\([^)]+\)"), "link")
        .when(c.startswith("- "), "bullet")
        .when(bare == "", "blank")
        .otherwise("para")
    )


def bold_parts(text: str | Column) -> Column:
    """A line as an array of ``(bold, text)``, split at ``**x**``, empty parts left out."""
    # A mark that no text holds: those it does hold are written with another one before the split.
    mark, other = F.lit("\u0001"), F.lit("\u0002")
    free = F.replace(F.replace(_c(text), other, F.lit("\u0002b")), mark, F.lit("\u0002a"))
    split = F.split(F.regexp_replace(free, r"\*\*[^*]+\*\*", F.concat(mark, F.lit("$0"), mark)), "\u0001")
    parts = F.transform(split, lambda p: F.replace(F.replace(p, F.lit("\u0002a"), mark), F.lit("\u0002b"), other))
    bold = lambda p: p.startswith("**") & p.endswith("**")
    shown = lambda p: F.when(bold(p), F.substring(p, F.lit(3), F.greatest(F.length(p) - 4, F.lit(0)))).otherwise(p)
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(bold(p).alias("bold"), shown(p).alias("text")))
