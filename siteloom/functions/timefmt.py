"""Time, interval and progress expressions; the time of reading is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom.functions.url import _c

#: Formats of a sitemap date, tried in order.
LASTMOD = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssZ")
#: Steps of a crawl in order.
STEPS = ("CRAWL", "FILTER", "CURATE", "GENERATE")


def lastmod(text: str | Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(_c(text), F.lit(f)) for f in LASTMOD])


def ago(at: str | Column, now: Column) -> Column:
    """Age in words: just now, minutes, hours, days, else the day."""
    t = _c(at)
    s = F.unix_timestamp(now) - F.unix_timestamp(t)
    some = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return (
        F.when(t.isNull(), "Never")
        .when(s < 60, "Just now")
        .when(s < 3600, some(60, "m ago"))
        .when(s < 86_400, some(3600, "h ago"))
        .when(s < 7 * 86_400, some(86_400, "d ago"))
        .otherwise(F.date_format(t, "MMM d"))
    )


def duration(start: str | Column, end: str | Column, now: Column) -> Column:
    """Seconds, or minutes and seconds; open ends count to ``now``."""
    s = F.unix_timestamp(F.coalesce(_c(end), now)) - F.unix_timestamp(_c(start))
    m = F.floor(s / 60)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(m.cast("string"), F.lit("m "), (s - m * 60).cast("string"), F.lit("s")))


def permille(done: str | Column, total: str | Column) -> Column:
    """Progress in thousandths, rounded down; 0 without a total."""
    d, t = _c(done), _c(total)
    return F.when(t > 0, F.floor(1000 * d / t)).otherwise(F.lit(0)).cast("long")


def eta_seconds(done: str | Column, total: str | Column, elapsed: str | Column) -> Column:
    """Seconds left at the pace so far; null without a pace."""
    d, t, e = _c(done), _c(total), _c(elapsed)
    return F.when((d > 0) & (e > 0), (t - d) * e / d)


def clamped(hours: str | Column, least: int = 6, most: int = 168) -> Column:
    return F.greatest(F.lit(least), F.least(_c(hours), F.lit(most)))


def step_state(step: str, current: str | Column) -> Column:
    """``complete``, ``active`` or ``pending`` of a step while ``current`` runs; unknown steps count as the first."""
    c = F.upper(_c(current))
    at = F.greatest(F.array_position(F.array(*map(F.lit, STEPS)), c), F.lit(1))
    mine = STEPS.index(step) + 1
    return F.when((c == "COMPLETE") | (at > mine), "complete").when(at == mine, "active").otherwise("pending")
