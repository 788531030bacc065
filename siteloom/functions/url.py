"""URL expressions. Three normal forms exist side by side and are not equivalent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a path that mark a link as no page, for crawling and for discovery.
SKIP_CRAWL = ("/wp-admin", "/wp-content", "/wp-includes", "/cdn-cgi/", "/api/", "/_next/", ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".css", ".js", ".xml", ".json")
SKIP_DISCOVERY = (*SKIP_CRAWL, ".ico", ".woff", ".woff2")

#: Fixed value: what a domain name looks like.
DOMAIN = r"^([a-zA-Z0-9]([a-zA-Z0-9\-]*[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}$"

_ORIGIN = r"^(https?://[^/?#]+)"
_PATH = r"^https?://[^/?#]+([^?#;]*)"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def page_key(url: str | Column) -> Column:
    """Spider form: origin and path in lower case, no trailing slash but the root's; query, fragment and params go."""
    u = _c(url)
    path = F.regexp_replace(F.regexp_extract(u, _PATH, 1), "/+$", "")
    return F.lower(F.concat(F.regexp_extract(u, _ORIGIN, 1), F.when(path == "", "/").otherwise(path)))


def inventory_key(url: str | Column) -> Column:
    """Inventory form: no trailing slashes, lower case; query and fragment stay."""
    return F.lower(F.regexp_replace(_c(url), "/+$", ""))


def site_key(url: str | Column) -> Column:
    """Homepage form: host without ``www.`` and path without trailing slash."""
    u = _c(url)
    return F.concat(F.replace(F.lower(host(u)), F.lit("www."), F.lit("")), F.regexp_replace(F.regexp_extract(u, _PATH, 1), "/+$", ""))


def host(url: str | Column) -> Column:
    """Authority with its port, '' without a web scheme."""
    return F.regexp_extract(_c(url), r"^https?://([^/?#]+)", 1)


def display_host(url: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host(url), r":\d+$", ""), r"^(.*?)www\.", "$1")


def trimmed(url: str | Column) -> Column:
    return F.regexp_replace(_c(url), "/+$", "")


def with_scheme(text: str | Column) -> Column:
    """Typed address: trimmed, ``https://`` put before it when it has no scheme."""
    t = F.trim(_c(text))
    return F.when(t.startswith("http://") | t.startswith("https://"), t).otherwise(F.concat(F.lit("https://"), t))


def format_error(url: str | Column) -> Column:
    """Why a URL is no site address, in fixed words; null if it is one."""
    u = _c(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    netloc = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    domain = F.regexp_replace(F.lower(netloc), ":.*$", "")
    valid = domain.rlike(DOMAIN) | (domain == "localhost")
    return (
        F.when(~scheme.isin("http", "https"), "URL must use http:// or https://")
        .when(netloc == "", "URL must include a domain name")
        .when(~valid, "Invalid domain name")
    )


def is_link(href: str | Column) -> Column:
    h = _c(href)
    return (h != "") & ~h.rlike(r"^(javascript:|mailto:|tel:|#)")


def is_skipped(url: str | Column, parts: tuple[str, ...] = SKIP_CRAWL) -> Column:
    """Whether the path, in lower case, contains any of ``parts`` anywhere."""
    path = F.lower(F.regexp_extract(_c(url), r"^https?://[^/?#]+([^?#]*)", 1))
    return path.rlike("|".join(p.replace(".", r"\.") for p in parts))


def nav_href(href: str | Column) -> Column:
    """A menu link without query and trailing slashes; null for anchors, scripts and empty ones."""
    h = _c(href)
    clean = F.regexp_replace(F.regexp_replace(h, r"\?.*$", ""), "/+$", "")
    return F.when(~h.startswith("#") & ~h.startswith("javascript:") & (clean != ""), clean)
