"""Checks of fetched addresses: ``(url, status, content_type, body, final_url)`` to verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions.html import checked_title
from siteloom.functions.url import format_error, trimmed

#: Messages for addresses that could not be fetched, by kind of error.
NETWORK = {
    "timeout": "Site took too long to respond (timeout)",
    "connect": "Could not connect to site. Check the URL and try again.",
    "redirects": "Too many redirects. The URL may be misconfigured.",
}


def checked(responses: DataFrame, *keep: str) -> DataFrame:
    """``(*keep, url, is_valid, error, final_url, title)``; a 403 passes, as what a site shows strangers."""
    status, body = F.col("status"), F.coalesce(F.col("body"), F.lit(""))
    network = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NETWORK.items() for x in kv]), F.col("error")), F.concat(F.lit("Could not access site: "), F.col("error")))
    error = (
        F.when(format_error("url").isNotNull(), format_error("url"))
        .when(F.col("error").isNotNull(), network)
        .when((status >= 400) & (status != 403), F.concat(F.lit("Site returned error: HTTP "), status.cast("string")))
        .when(status == 403, None)
        .when(~F.lower(F.coalesce(F.col("content_type"), F.lit(""))).contains("text/html"), "URL does not point to an HTML page")
        .when(F.length(F.trim(body)) < 10, "Page appears to be empty or has minimal content")
    )
    found = responses.withColumn("_e", error)
    title = F.when(status == 403, F.coalesce(checked_title("body"), F.lit("Protected Site"))).otherwise(checked_title("body"))
    final = F.when(status == 403, trimmed("url")).otherwise(trimmed("final_url"))
    ok = F.col("_e").isNull()
    return found.select(*keep, "url", ok.alias("is_valid"), F.col("_e").alias("error"), F.when(ok, final).alias("final_url"), F.when(ok, title).alias("title"))
