"""HTML expressions by pattern, for what is defined by a pattern; ``functions.dom`` reads the tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom.functions.dom import unescaped
from siteloom.functions.url import _c

#: Fixed values, here and in the functions below: patterns of a title, of a checked one, and of a menu and its targets.
TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def stripped(text: str | Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def raw_title(html: str | Column) -> Column:
    """Title as written, entities and all, for drift."""
    return stripped(F.regexp_extract(_c(html), TITLE, 1))


def checked_title(html: str | Column) -> Column:
    """Title of a checked address: no markup inside, 200 characters, then decoded; null if none."""
    found = F.regexp_extract(_c(html), r"(?i)<title[^>]*>([^<]+)</title>", 1)
    return F.when(found != "", unescaped(F.substring(stripped(found), 1, 200)))


def menu_targets(html: str | Column) -> Column:
    """Distinct link targets of the first ``nav``, else ``header``, for drift."""
    h = _c(html)
    nav, header = (F.regexp_extract(h, rf"(?is)<{t}[^>]*>(.*?)</{t}>", 1) for t in ("nav", "header"))
    return F.array_distinct(F.regexp_extract_all(F.when(nav != "", nav).otherwise(header), F.lit(r"""href=["']([^"'#]+)["']"""), 1))
