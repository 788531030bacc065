"""Change between snapshots: inventory, hashes, drift and what they decide."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from siteloom.conf import CONF
from siteloom.functions.html import menu_targets, raw_title


def inventory_diff(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``(site, key, status)``: ``new``, ``removed`` or ``existing`` between two sets ``(site, key)``."""
    a = stored.select("site", "key").distinct().withColumn("_s", F.lit(True))
    b = incoming.select("site", "key").distinct().withColumn("_i", F.lit(True))
    status = F.when(F.col("_s").isNull(), "new").when(F.col("_i").isNull(), "removed").otherwise("existing")
    return a.join(b, ["site", "key"], "full").select("site", "key", status.alias("status"))


def inventory_upsert(stored: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Stored rows ``(site, key, first_seen, last_seen)`` with incoming keys touched or added; none leave."""
    b = incoming.select("site", "key").distinct().withColumn("_i", F.lit(True))
    return stored.join(b, ["site", "key"], "full").select(
        "site", "key", F.coalesce("first_seen", now).alias("first_seen"), F.when(F.col("_i"), now).otherwise(F.col("last_seen")).alias("last_seen")
    )


def categorize(crawled: DataFrame, curated: DataFrame, seen: DataFrame) -> DataFrame:
    """``(site, key, category)`` of crawled and curated keys against what was ever seen."""
    flag = lambda df, name: df.select("site", "key").distinct().withColumn(name, F.lit(True))
    all3 = flag(crawled, "c").join(flag(curated, "k"), ["site", "key"], "full").join(flag(seen, "s"), ["site", "key"], "left")
    category = F.when(F.col("c") & F.col("k"), "still_curated").when(F.col("k"), "removed_from_site").when(F.col("s"), "previously_filtered").otherwise("new")
    return all3.select("site", "key", category.alias("category"))


def mismatch(old: str | Column, new: str | Column) -> Column:
    """``deleted``, ``changed`` or ``same`` of two hashes, '' meaning none; null where there was none."""
    o, n = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (old, new))
    return F.when((n == "") & (o != ""), "deleted").when((o != "") & (n != "") & (o != n), "changed").when(o != "", "same")


def regeneration(counts: DataFrame) -> DataFrame:
    """``(site, full, reason)`` from ``curated, removed, significant, new_pages, sections, new_sections``.

    Shares are strict, the section rule is not; the first rule that fits decides.
    """
    c = F.col
    rules = (
        F.when(c("curated") == 0, "no_curated")
        .when(c("removed") * 100 > c("curated") * 50, "removed")
        .when(c("significant") * 100 > c("curated") * 50, "significant")
        .when(c("new_pages") * 100 > c("curated") * 30, "expansion")
        .when((c("new_sections") > 0) & (c("sections") > 0) & (c("new_sections") >= c("sections")), "sections")
        .otherwise("within")
    )
    return counts.select("site", rules.alias("reason")).select("site", (~c("reason").isin("no_curated", "within")).alias("full"), "reason")


@F.pandas_udf(LongType())
def _common(old: pd.Series, new: pd.Series) -> pd.Series:
    """How many characters the two have in common, order aside."""

    def counts(text: str, top: int) -> np.ndarray:
        return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), minlength=top)

    def one(a: str | None, b: str | None) -> int | None:
        if a is None or b is None:
            return None
        top = max(map(ord, max(a, default="\0") + max(b, default="\0"))) + 1
        return int(np.minimum(counts(a, top), counts(b, top)).sum())

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)], dtype="Int64")


def diff_percent(old: str = "old", new: str = "new", most: int = CONF.diff_chars) -> Column:
    """Percentage of change between two texts.

    Very unlike lengths decide alone. Otherwise both sides' first ``most`` characters are
    counted, and the common ones make up the likeness.
    """
    o, n = F.length(old), F.length(new)
    ratio = F.least(o, n) / F.greatest(o, n, F.lit(1))
    a, b = F.substring(old, 1, most), F.substring(new, 1, most)
    both = F.greatest(F.length(a) + F.length(b), F.lit(1))
    return (
        F.when((o == 0) & (n == 0), F.lit(0.0))
        .when((o == 0) | (n == 0), F.lit(100.0))
        .when(ratio < 0.5, (1 - ratio) * 100)
        .otherwise((1 - 2.0 * _common(a, b) / both) * 100)
    )


def diff_share(pairs: DataFrame, id_cols: tuple[str, ...] = ("page_id",), most: int = CONF.diff_chars) -> DataFrame:
    """``(*id_cols, diff)``: percentage of change between ``old`` and ``new``, without a shuffle."""
    return pairs.select(*id_cols, diff_percent("old", "new", most).alias("diff"))


def title_changed(old: str, new: str) -> Column:
    return raw_title(old) != raw_title(new)


def nav_changed(old: str, new: str) -> Column:
    """More than a fifth of the menu differs; one empty menu is a change, two are none."""
    a, b = menu_targets(old), menu_targets(new)
    apart = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, False).when((F.size(a) == 0) | (F.size(b) == 0), True).otherwise(apart * 5 > most)


def length_changed(old: str, new: str) -> Column:
    o, n = F.length(old), F.length(new)
    return F.when(o == 0, n > 1000).otherwise(F.abs(n - o) / o > 0.3)


def drift_scores(pairs: DataFrame, id_cols: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``(*id_cols, score)`` 0 to 100 of pairs ``(old, new)``; an empty side scores 0."""
    found = pairs.withColumn("diff", diff_percent())
    points = (
        F.least(F.lit(40.0), F.col("diff") * 0.4)
        + F.when(title_changed("old", "new"), 20).otherwise(0)
        + F.when(nav_changed("old", "new"), 25).otherwise(0)
        + F.when(length_changed("old", "new"), 15).otherwise(0)
    )
    score = F.when((F.length("old") == 0) | (F.length("new") == 0), 0).otherwise(F.least(F.lit(100), F.floor(points)))
    return found.select(*id_cols, score.cast("long").alias("score"))


def drift_decision(scores: DataFrame, totals: DataFrame, bulk_percent: int = 20, threshold: int = CONF.drift_threshold) -> DataFrame:
    """``(site, significant, reason)`` of changed pages' ``(site, score)`` and ``(site, total)``."""
    found = totals.join(scores.groupBy("site").agg(F.count("*").alias("changed"), F.sum("score").alias("points")), "site", "left")
    changed = F.coalesce("changed", F.lit(0))
    reason = (
        F.when(changed == 0, "no_changes")
        .when(changed * 100 > F.col("total") * bulk_percent, "bulk_change")
        .when(F.col("points") >= threshold * F.col("changed"), "cumulative_drift")
        .otherwise("below_threshold")
    )
    return found.select("site", changed.cast("long").alias("changed"), reason.alias("reason")).select("site", "changed", F.col("reason").isin("bulk_change", "cumulative_drift").alias("significant"), "reason")


def section_changes(curated: DataFrame, crawled: DataFrame) -> DataFrame:
    """``(site, section, n_urls, n_removed, n_changed, regenerate)`` of curated ``(site, section, key, hash)``
    against crawled ``(site, key, hash)``."""
    new = crawled.groupBy("site", "key").agg(F.max("hash").alias("new_hash"))
    joined = curated.select("site", "section", "key", "hash").distinct().join(new, ["site", "key"], "left")
    gone = F.col("new_hash").isNull()
    changed = ~gone & (F.col("hash") != "") & (F.col("new_hash") != "") & (F.col("hash") != F.col("new_hash"))
    found = joined.groupBy("site", "section").agg(F.count("*").alias("n_urls"), F.count_if(gone).alias("n_removed"), F.count_if(changed).alias("n_changed"))
    return found.withColumn("regenerate", F.col("n_removed") + F.col("n_changed") > 0)


def overview_changes(sections: DataFrame, added: DataFrame) -> DataFrame:
    """``(site, overview_changed, new_section_needed)``: over half removed or changed; over 30 % added."""
    total = sections.groupBy("site").agg(*[F.sum(c).alias(c) for c in ("n_urls", "n_removed", "n_changed")])
    more = total.join(added, "site", "left").withColumn("n_added", F.coalesce("n_added", F.lit(0)))
    big = (F.col("n_removed") * 2 > F.col("n_urls")) | (F.col("n_changed") * 2 > F.col("n_urls"))
    return more.select("site", big.alias("overview_changed"), (F.col("n_added") * 100 > 30 * F.greatest("n_urls", F.lit(1))).alias("new_section_needed"))


def rescrape(checks: DataFrame, cooldowns: DataFrame, now: Column, bulk_percent: int = CONF.bulk_change_percent) -> DataFrame:
    """``(site, action)`` of checks ``(site, total, changed, drift_significant)`` and ``(site, expires)``.

    Changes beyond the bulk share, or significant drift, ask for a rescrape unless the
    site cools down; a cooldown that ends now is over.
    """
    joined = checks.join(cooldowns, "site", "left")
    wanted = (F.col("changed") * 100 > F.col("total") * bulk_percent) | F.col("drift_significant")
    action = F.when((F.col("changed") == 0) | ~wanted, "reschedule").when(F.col("expires") > now, "cooling_down").otherwise("rescrape")
    return joined.select("site", action.alias("action"))
