"""Queries on two snapshots: inventory, change, drift, sections, curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions.dom import facts, title_of
from siteloom.functions.text import content_hash, unfenced
from siteloom.functions.url import host, inventory_key
from siteloom.operators import change, curate, digest, versions
from siteloom.operators.links import section_of
from siteloom.plans.base import HOST, KEY, SNAPSHOTS, curated, hashed, new_snapshot, old_snapshot, pages, query, sql_clean, sql_hash, sql_main, sql_title, table

_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_SEG = "regexp_extract(url, '^https?://[^/?#]+/([^/?#]*)', 1)"
_DIFF = "diff AS (SELECT coalesce(x.site, y.site) AS site, coalesce(x.key, y.key) AS key, CASE WHEN x.key IS NULL THEN 'new' WHEN y.key IS NULL THEN 'removed' ELSE 'existing' END AS status FROM (SELECT DISTINCT site, key FROM a) x FULL JOIN (SELECT DISTINCT site, key FROM b) y ON x.site = y.site AND x.key = y.key)"


@query("inventory_diff", f"WITH {SNAPSHOTS}, {_DIFF} SELECT * FROM diff")
def inventory_diff(spark, d):
    return change.inventory_diff(old_snapshot(spark, d), new_snapshot(spark, d))


@query("inventory_upsert", f"""WITH {SNAPSHOTS}, {_DIFF} SELECT site, key, CASE WHEN status = 'new' THEN epoch_us({_NOW}) ELSE epoch_us(TIMESTAMP '2024-01-01') END AS first_seen,
    CASE WHEN status = 'removed' THEN epoch_us(TIMESTAMP '2024-01-01') ELSE epoch_us({_NOW}) END AS last_seen FROM diff""")
def inventory_upsert(spark, d):
    then = F.lit("2024-01-01").cast("timestamp")
    stored = old_snapshot(spark, d).select("site", "key").distinct().withColumn("first_seen", then).withColumn("last_seen", then)
    out = change.inventory_upsert(stored, new_snapshot(spark, d), F.lit("2024-01-31").cast("timestamp"))
    return out.select("site", "key", F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("last_seen").alias("last_seen"))


@query("page_categorize", f"""WITH {SNAPSHOTS} SELECT coalesce(x.site, y.site) AS site, coalesce(x.key, y.key) AS key,
    CASE WHEN x.key IS NOT NULL AND y.key IS NOT NULL THEN 'still_curated' WHEN y.key IS NOT NULL THEN 'removed_from_site' WHEN (x.site, x.key) IN (SELECT site, key FROM a) THEN 'previously_filtered' ELSE 'new' END AS category
    FROM (SELECT DISTINCT site, key FROM b) x FULL JOIN (SELECT DISTINCT site, key FROM k) y ON x.site = y.site AND x.key = y.key""")
def page_categorize(spark, d):
    return change.categorize(new_snapshot(spark, d), curated(spark, d), old_snapshot(spark, d))


_HASHED = f"""ha AS (SELECT site, key, max({sql_hash()}) AS hash FROM a GROUP BY ALL), hb AS (SELECT site, key, max({sql_hash()}) AS hash FROM b GROUP BY ALL), hk AS (SELECT site, key, max({sql_hash()}) AS hash FROM k GROUP BY ALL)"""
_STATES = "st AS (SELECT hk.site, hk.key, CASE WHEN hb.hash = '' AND hk.hash <> '' THEN 'deleted' WHEN hk.hash <> '' AND hb.hash <> '' AND hk.hash <> hb.hash THEN 'changed' WHEN hk.hash <> '' THEN 'same' END AS state FROM hk JOIN hb ON hk.site = hb.site AND hk.key = hb.key)"


def _hashes(df):
    return hashed(df).groupBy("site", "key").agg(F.max("hash").alias("hash"))


def _states(spark, d):
    new = _hashes(new_snapshot(spark, d)).withColumnRenamed("hash", "new_hash")
    both = _hashes(curated(spark, d)).join(new, ["site", "key"])
    return both.select("site", "key", change.mismatch("hash", "new_hash").alias("state"))


@query("hash_mismatch", f"WITH {SNAPSHOTS}, {_HASHED}, {_STATES} SELECT * FROM st")
def hash_mismatch(spark, d):
    return _states(spark, d)


@query("removed_curated", f"WITH {SNAPSHOTS} SELECT DISTINCT site, key FROM k WHERE (site, key) NOT IN (SELECT site, key FROM b)")
def removed_curated(spark, d):
    return curated(spark, d).select("site", "key").distinct().join(new_snapshot(spark, d).select("site", "key"), ["site", "key"], "left_anti")


@query("scrape_set", f"WITH {SNAPSHOTS}, {_DIFF} SELECT site, key FROM k WHERE (site, key) IN (SELECT site, key FROM b) UNION SELECT site, key FROM diff WHERE status = 'new'")
def scrape_set(spark, d):
    new = new_snapshot(spark, d).select("site", "key")
    kept = curated(spark, d).select("site", "key").join(new, ["site", "key"], "left_semi")
    added = new.join(old_snapshot(spark, d).select("site", "key"), ["site", "key"], "left_anti")
    return kept.union(added).distinct()


@query("change_ratio", f"""WITH {SNAPSHOTS}, {_HASHED}, {_STATES} SELECT site, count(*) AS total, count(*) FILTER (state IN ('changed', 'deleted')) AS changed,
    count(*) FILTER (state IN ('changed', 'deleted')) * 100 > count(*) AS bulk FROM st GROUP BY site""")
def change_ratio(spark, d):
    changed = F.count_if(F.col("state").isin("changed", "deleted"))
    return _states(spark, d).groupBy("site").agg(F.count("*").alias("total"), changed.alias("changed"), (changed * 100 > F.count("*")).alias("bulk"))


_COUNTS = f"""cu AS (SELECT site, count(DISTINCT key) AS curated, count(DISTINCT key) FILTER ((site, key) NOT IN (SELECT site, key FROM b)) AS removed, count(DISTINCT {_SEG}) AS sections FROM k GROUP BY site),
    si AS (SELECT site, count(*) AS significant FROM st WHERE state IN ('changed', 'deleted') GROUP BY site),
    ne AS (SELECT site, count(DISTINCT key) AS new_pages, count(DISTINCT {_SEG}) FILTER ((site, {_SEG}) NOT IN (SELECT site, {_SEG} FROM k)) AS new_sections FROM b WHERE (site, key) NOT IN (SELECT site, key FROM a) GROUP BY site),
    co AS (SELECT s.site, coalesce(curated, 0) AS curated, coalesce(removed, 0) AS removed, coalesce(significant, 0) AS significant, coalesce(new_pages, 0) AS new_pages, coalesce(sections, 0) AS sections, coalesce(new_sections, 0) AS new_sections
      FROM (SELECT DISTINCT {HOST} AS site FROM pages) s LEFT JOIN cu USING (site) LEFT JOIN si USING (site) LEFT JOIN ne USING (site))"""


def _counts(spark, d):
    k, b, a = curated(spark, d), new_snapshot(spark, d), old_snapshot(spark, d)
    gone = k.select("site", "key").distinct().join(b.select("site", "key"), ["site", "key"], "left_anti").groupBy("site").agg(F.count("*").alias("removed"))
    have = k.groupBy("site").agg(F.count_distinct("key").alias("curated"), F.count_distinct(section_of("url")).alias("sections"))
    hot = _states(spark, d).where(F.col("state").isin("changed", "deleted")).groupBy("site").agg(F.count("*").alias("significant"))
    added = b.join(a.select("site", "key"), ["site", "key"], "left_anti").withColumn("section", section_of("url"))
    new = added.groupBy("site").agg(F.count_distinct("key").alias("new_pages"))
    fresh = added.select("site", "section").distinct().join(k.select("site", section_of("url").alias("section")), ["site", "section"], "left_anti").groupBy("site").agg(F.count("*").alias("new_sections"))
    sites = pages(spark, d).select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("site")).distinct()
    for df in (have, gone, hot, new, fresh):
        sites = sites.join(df, "site", "left")
    return sites.na.fill(0)


@query("regen_threshold", f"""WITH {SNAPSHOTS}, {_HASHED}, {_STATES}, {_COUNTS}, r AS (SELECT site, CASE WHEN curated = 0 THEN 'no_curated' WHEN removed * 100 > curated * 50 THEN 'removed' WHEN significant * 100 > curated * 50 THEN 'significant'
    WHEN new_pages * 100 > curated * 30 THEN 'expansion' WHEN new_sections > 0 AND sections > 0 AND new_sections >= sections THEN 'sections' ELSE 'within' END AS reason FROM co) SELECT site, reason NOT IN ('no_curated', 'within') AS "full", reason FROM r""")
def regen_threshold(spark, d):
    return change.regeneration(_counts(spark, d))


_SECTIONS = f"""se AS (SELECT x.site, x.section, count(*) AS n_urls, count(*) FILTER (hb.hash IS NULL) AS n_removed, count(*) FILTER (hb.hash <> '' AND x.hash <> '' AND hb.hash <> x.hash) AS n_changed
    FROM (SELECT DISTINCT k.site, {_SEG} AS section, k.key, hk.hash FROM k JOIN hk ON k.site = hk.site AND k.key = hk.key) x LEFT JOIN hb ON x.site = hb.site AND x.key = hb.key GROUP BY ALL)"""


def _sections(spark, d):
    k = curated(spark, d)
    held = k.select("site", "key", section_of("url").alias("section")).join(_hashes(k), ["site", "key"])
    return change.section_changes(held, _hashes(new_snapshot(spark, d)))


@query("section_significance", f"WITH {SNAPSHOTS}, {_HASHED}, {_SECTIONS} SELECT *, n_removed + n_changed > 0 AS regenerate FROM se")
def section_significance(spark, d):
    return _sections(spark, d)


@query("overview_decision", f"""WITH {SNAPSHOTS}, {_HASHED}, {_SECTIONS}, ad AS (SELECT site, count(DISTINCT key) AS n_added FROM b WHERE (site, key) NOT IN (SELECT site, key FROM k) GROUP BY site),
    t AS (SELECT site, sum(n_urls) AS u, sum(n_removed) AS r, sum(n_changed) AS c FROM se GROUP BY site)
    SELECT t.site, r * 2 > u OR c * 2 > u AS overview_changed, coalesce(n_added, 0) * 100 > 30 * greatest(u, 1) AS new_section_needed FROM t LEFT JOIN ad ON t.site = ad.site""")
def overview_decision(spark, d):
    k = curated(spark, d).select("site", "key")
    added = new_snapshot(spark, d).select("site", "key").distinct().join(k, ["site", "key"], "left_anti").groupBy("site").agg(F.count("*").alias("n_added"))
    return change.overview_changes(_sections(spark, d), added)


_PAIRS = "p AS (SELECT a.page_id, a.site, a.html AS old, b.html AS new FROM a JOIN b ON a.page_id = b.page_id)"
_RAW = "trim(regexp_extract({0}, '(?is)<title[^>]*>(.*?)</title>', 1))"


def _menu(x):
    return f"""list_distinct(regexp_extract_all(coalesce(nullif(regexp_extract({x}, '(?is)<nav[^>]*>(.*?)</nav>', 1), ''), regexp_extract({x}, '(?is)<header[^>]*>(.*?)</header>', 1)), 'href=["'']([^"''#]+)["'']', 1))"""


_DRIFT = f"""rat AS (SELECT *, CASE WHEN length(old) = 0 AND length(new) = 0 THEN 0.0::DOUBLE WHEN length(old) = 0 OR length(new) = 0 THEN 100.0::DOUBLE
      WHEN least(length(old), length(new))::DOUBLE / greatest(length(old), length(new)) < 0.5 THEN (1 - least(length(old), length(new))::DOUBLE / greatest(length(old), length(new))) * 100 END AS simple FROM p),
    ch AS (SELECT page_id, c, sum(x) AS x, sum(y) AS y FROM (SELECT page_id, unnest(string_split(substring(old, 1, 10000), '')) AS c, 1 AS x, 0 AS y FROM rat WHERE simple IS NULL
      UNION ALL SELECT page_id, unnest(string_split(substring(new, 1, 10000), '')), 0, 1 FROM rat WHERE simple IS NULL) WHERE c <> '' GROUP BY ALL),
    df AS (SELECT page_id, simple AS diff FROM rat WHERE simple IS NOT NULL UNION ALL SELECT page_id, (1 - 2.0::DOUBLE * sum(least(x, y)) / sum(x + y)) * 100 FROM ch GROUP BY page_id),
    nv AS (SELECT page_id, {_menu('old')} AS m, {_menu('new')} AS w FROM p),
    nc AS (SELECT page_id, CASE WHEN len(m) = 0 AND len(w) = 0 THEN false WHEN len(m) = 0 OR len(w) = 0 THEN true
      ELSE (len(list_filter(m, lambda h: NOT list_contains(w, h))) + len(list_filter(w, lambda h: NOT list_contains(m, h)))) * 5 > greatest(len(m), len(w)) END AS nav_changed FROM nv),
    lc AS (SELECT page_id, CASE WHEN length(old) = 0 THEN length(new) > 1000 ELSE abs(length(new) - length(old))::DOUBLE / length(old) > 0.3 END AS length_changed FROM p),
    sc AS (SELECT p.page_id, p.site, CASE WHEN length(old) = 0 OR length(new) = 0 THEN 0 ELSE least(100, floor(least(40.0::DOUBLE, diff * 0.4::DOUBLE) + CASE WHEN {_RAW.format('old')} <> {_RAW.format('new')} THEN 20 ELSE 0 END
      + CASE WHEN nav_changed THEN 25 ELSE 0 END + CASE WHEN length_changed THEN 15 ELSE 0 END)) END::BIGINT AS score FROM p JOIN df USING (page_id) JOIN nc USING (page_id) JOIN lc USING (page_id))"""


def _pairs(spark, d):
    new = new_snapshot(spark, d).select("page_id", F.col("html").alias("new"))
    return old_snapshot(spark, d).select("page_id", "site", F.col("html").alias("old")).join(new, "page_id")


@query("page_title_changed", f"WITH {SNAPSHOTS}, {_PAIRS} SELECT page_id, {_RAW.format('old')} <> {_RAW.format('new')} AS title_changed FROM p")
def page_title_changed(spark, d):
    return _pairs(spark, d).select("page_id", change.title_changed("old", "new").alias("title_changed"))


@query("drift_diff_pct", f"WITH {SNAPSHOTS}, {_PAIRS}, {_DRIFT} SELECT page_id, floor(diff * 1000)::BIGINT AS diff FROM df")
def drift_diff_pct(spark, d):
    return change.diff_share(_pairs(spark, d)).select("page_id", F.floor(F.col("diff") * 1000).cast("long").alias("diff"))


@query("drift_nav", f"WITH {SNAPSHOTS}, {_PAIRS}, {_DRIFT} SELECT * FROM nc")
def drift_nav(spark, d):
    return _pairs(spark, d).select("page_id", change.nav_changed("old", "new").alias("nav_changed"))


@query("drift_length", f"WITH {SNAPSHOTS}, {_PAIRS}, {_DRIFT} SELECT * FROM lc")
def drift_length(spark, d):
    return _pairs(spark, d).select("page_id", change.length_changed("old", "new").alias("length_changed"))


@query("drift_score", f"WITH {SNAPSHOTS}, {_PAIRS}, {_DRIFT} SELECT page_id, score FROM sc")
def drift_score(spark, d):
    return change.drift_scores(_pairs(spark, d))


_BATCH = """tt AS (SELECT site, count(*) AS total FROM p GROUP BY site), cs AS (SELECT site, count(*) AS changed, sum(score) AS points FROM sc WHERE page_id IN (SELECT page_id FROM p WHERE old <> new) GROUP BY site),
    dd AS (SELECT tt.site, coalesce(changed, 0) AS changed, CASE WHEN coalesce(changed, 0) = 0 THEN 'no_changes' WHEN changed * 100 > total * 20 THEN 'bulk_change' WHEN points >= 30 * changed THEN 'cumulative_drift' ELSE 'below_threshold' END AS reason FROM tt LEFT JOIN cs ON tt.site = cs.site),
    de AS (SELECT site, changed, reason IN ('bulk_change', 'cumulative_drift') AS significant, reason FROM dd)"""


def _decided(spark, d):
    pairs = _pairs(spark, d)
    scores = change.drift_scores(pairs.where("old <> new"), ("page_id", "site"))
    return change.drift_decision(scores, pairs.groupBy("site").agg(F.count("*").alias("total")))


@query("drift_batch", f"WITH {SNAPSHOTS}, {_PAIRS}, {_DRIFT}, {_BATCH} SELECT * FROM de")
def drift_batch(spark, d):
    return _decided(spark, d)


_COOL = "cd AS (SELECT site, CASE WHEN site LIKE 'm.%' THEN TIMESTAMP '2024-01-31 01:00:00' WHEN site LIKE 'www.%' THEN TIMESTAMP '2024-01-31 00:00:00' END AS expires FROM (SELECT DISTINCT site FROM a))"


@query("rescrape_decision", f"""WITH {SNAPSHOTS}, {_PAIRS}, {_DRIFT}, {_BATCH}, {_COOL}
    SELECT de.site, CASE WHEN changed = 0 OR NOT (changed * 100 > total * 1 OR significant) THEN 'reschedule' WHEN expires > {_NOW} THEN 'cooling_down' ELSE 'rescrape' END AS action FROM de JOIN tt USING (site) LEFT JOIN cd USING (site)""")
def rescrape_decision(spark, d):
    """Mobile sites cool down for another hour, ``www`` sites until now."""
    total = _pairs(spark, d).groupBy("site").agg(F.count("*").alias("total"))
    checks = _decided(spark, d).withColumnRenamed("significant", "drift_significant").join(total, "site")
    at = F.when(F.col("site").startswith("m."), "2024-01-31 01:00:00").when(F.col("site").startswith("www."), "2024-01-31 00:00:00").cast("timestamp")
    cool = old_snapshot(spark, d).select("site").distinct().withColumn("expires", at)
    return change.rescrape(checks, cool, F.lit("2024-01-31").cast("timestamp"))


@query("lightweight_check", f"""WITH {SNAPSHOTS}, {_HASHED}, {_STATES}, c AS (SELECT site, count(*) AS checked, count(*) FILTER (state = 'changed') AS changed FROM st WHERE state IS NOT NULL GROUP BY site)
    SELECT site, checked, changed, CASE WHEN changed = 0 THEN 'unchanged' WHEN changed * 100 > checked THEN 'rescrape' ELSE 'drift' END AS outcome FROM c""")
def lightweight_check(spark, d):
    """An unfetched page counts as unchanged; beyond the bulk share a site goes straight to a rescrape."""
    found = _states(spark, d).where("state IS NOT NULL").groupBy("site").agg(F.count("*").alias("checked"), F.count_if(F.col("state") == "changed").alias("changed"))
    outcome = F.when(F.col("changed") == 0, "unchanged").when(F.col("changed") * 100 > F.col("checked"), "rescrape").otherwise("drift")
    return found.withColumn("outcome", outcome)


_NAMES = "CASE regexp_extract(url, '^https?://[^/?#]+/([^/?#]*)', 1) WHEN 'en' THEN 'Resources' WHEN 'es' THEN 'Solutions' WHEN 'de' THEN 'Guides' WHEN 'fr' THEN 'Company' ELSE 'Other' END"
_SORTED = f"sp AS (SELECT page_id, {HOST} AS site, url, {sql_title('html')} AS title, {_NAMES} AS section, {_SEG} AS category FROM pages)"


def sectioned(spark, d):
    """Pages with a section by language: three standard ones and one of the site's own."""
    seg = section_of("url")
    name = F.when(seg == "en", "Resources").when(seg == "es", "Solutions").when(seg == "de", "Guides").when(seg == "fr", "Company").otherwise("Other")
    return pages(spark, d).select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("site"), "url", title_of("html").alias("title"), name.alias("section"), seg.alias("category"))


@query("section_hash", f"WITH {_SORTED}, h AS (SELECT sp.*, sha256(html) AS hash FROM sp JOIN pages USING (page_id)) SELECT site, section, sha256(string_agg(hash, '|' ORDER BY h.url, hash)) AS hash FROM h GROUP BY ALL")
def section_hash(spark, d):
    marks = pages(spark, d).select("page_id", content_hash("html").alias("hash"))
    return digest.section_hash(sectioned(spark, d).join(marks, "page_id"), ["site", "section"])


@query("section_group", f"WITH {_SORTED} SELECT site, section, count(*) AS n, string_agg(url, ' ' ORDER BY url) AS urls FROM sp GROUP BY ALL")
def section_group(spark, d):
    return sectioned(spark, d).groupBy("site", "section").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("url")), " ").alias("urls"))


@query("section_order", f"""WITH {_SORTED}, s AS (SELECT site, section, min(page_id) AS ord, coalesce(nullif(list_position(['Platform Features','Solutions','Integrations','Resources','Pricing','Company','Other'], section), 0), 999) AS rank FROM sp GROUP BY ALL)
    SELECT site, section, row_number() OVER (PARTITION BY site ORDER BY rank, ord) AS place FROM s""")
def section_order(spark, d):
    from pyspark.sql import Window

    found = sectioned(spark, d).groupBy("site", "section").agg(F.min("page_id").alias("ord"))
    place = F.row_number().over(Window.partitionBy("site").orderBy(curate.section_rank("section"), "ord")).cast("long")
    return found.select("site", "section", place.alias("place"))


@query("section_summary", f"WITH {_SORTED} SELECT site, section, count(*) AS link_count, count(DISTINCT url) AS n_urls, string_agg(DISTINCT url, ' ' ORDER BY url) AS urls FROM sp GROUP BY site, section")
def section_summary(spark, d):
    urls = F.array_sort(F.collect_set("url"))
    found = sectioned(spark, d).groupBy("site", "section").agg(F.count("*").alias("link_count"), urls.alias("u"))
    return found.select("site", "section", "link_count", F.size("u").cast("long").alias("n_urls"), F.array_join("u", " ").alias("urls"))


_ASSIGNED = """asg AS (SELECT site, 1 AS section_ord, 'All' AS section, page_id AS page_ord, upper(url) || '/' AS url FROM sp WHERE contains(url, '?page=') UNION ALL SELECT site, 2, section, page_id, url FROM sp UNION ALL SELECT site, 3, 'Made up', page_id, url || '/none' FROM sp)"""


def _assigned(spark, d):
    s = sectioned(spark, d)
    one = s.where(F.col("url").contains("?page=")).select("site", F.lit(1).alias("section_ord"), F.lit("All").alias("section"), F.col("page_id").alias("page_ord"), F.concat(F.upper("url"), F.lit("/")).alias("url"))
    two = s.select("site", F.lit(2), "section", "page_id", "url")
    return one.union(two).union(s.select("site", F.lit(3), F.lit("Made up"), "page_id", F.concat("url", F.lit("/none"))))


@query("url_grounding", f"""WITH {_SORTED}, {_ASSIGNED}, g AS (SELECT *, {KEY} AS key FROM asg) SELECT site, section, key FROM (SELECT *, row_number() OVER (PARTITION BY site, key ORDER BY section_ord, page_ord) AS n FROM g WHERE (site, key) IN (SELECT site, {KEY} FROM sp)) WHERE n = 1""")
def url_grounding(spark, d):
    return curate.grounded(_assigned(spark, d), sectioned(spark, d)).select("site", "section", "key")


@query("first_section_wins", f"WITH {_SORTED}, {_ASSIGNED} SELECT site, section, url FROM (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY section_ord, page_ord) AS n FROM asg) WHERE n = 1")
def first_section_wins(spark, d):
    return versions.replace_curated(_assigned(spark, d)).select("site", "section", "url")


@query("selective_update", f"""WITH {SNAPSHOTS}, {_HASHED}, {_STATES} SELECT k.site, k.url, CASE WHEN st.state = 'changed' THEN 'updated' ELSE 'kept' END AS description, CASE WHEN st.state = 'changed' THEN hb.hash ELSE hk.hash END AS hash
    FROM k JOIN hk ON k.site = hk.site AND k.key = hk.key JOIN hb ON k.site = hb.site AND k.key = hb.key LEFT JOIN st ON k.site = st.site AND k.key = st.key""")
def selective_update(spark, d):
    k = curated(spark, d)
    held = k.join(_hashes(k), ["site", "key"]).select("site", "url", F.lit("kept").alias("description"), "hash")
    new = _hashes(new_snapshot(spark, d))
    gone = k.select("site", "url", "key").join(new, ["site", "key"], "left_anti")
    changed = _states(spark, d).where("state = 'changed'").join(new, ["site", "key"]).select("site", F.col("key").alias("url"), F.lit("updated").alias("description"), "hash")
    return versions.selective_update(held, gone, changed)


@query("empty_page_prefilter", "SELECT doc_id, length(trim(text)) >= 50 AS kept FROM documents")
def empty_page_prefilter(spark, d):
    return table(spark, d, "documents").select("doc_id", curate.substantial("text").alias("kept"))


@query("relevance_batches", f"SELECT page_id, {HOST} AS site, (row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) - 1) // 25 AS batch FROM pages")
def relevance_batches(spark, d):
    return curate.batches(sectioned(spark, d)).select("page_id", "site", "batch")


_IRRELEVANT = "|".join(curate.IRRELEVANT)


@query("relevance_rules", f"SELECT page_id FROM pages WHERE NOT regexp_matches(lower(url), '{_IRRELEVANT}')")
def relevance_rules(spark, d):
    """Through the batch provider and its JSON replies, as a language model would answer."""
    batched = curate.batches(sectioned(spark, d))
    return curate.kept_by_replies(batched, curate.replies(batched)).select("page_id")


_TEXTS = f"tx AS (SELECT page_id, {HOST} AS site, url, {sql_title('html')} AS title, {sql_main(sql_clean('html'))} AS text, (row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) - 1) AS n FROM pages)"


@query("prompt_pages", f"""WITH {_TEXTS} SELECT site, n // 25 AS batch, string_agg((n % 25 + 1) || '. URL: ' || url || chr(10) || '   Title: ' || CASE WHEN title = '' THEN 'Untitled' ELSE title END || chr(10)
    || CASE WHEN length(trim(text)) > 50 THEN '   Content:' || chr(10) || CASE WHEN length(text) > 2000 THEN trim(substring(text, 1, 2000)) || '...' ELSE trim(text) END || chr(10) WHEN text = '' THEN '   Content: [EMPTY PAGE - NO CONTENT]' || chr(10) ELSE '' END, chr(10) ORDER BY n) AS prompt FROM tx GROUP BY ALL""")
def prompt_pages(spark, d):
    from pyspark.sql import Window

    page = pages(spark, d).select("page_id", host("url").alias("site"), "url", facts("html").alias("page")).select("page_id", "site", "url", "page.title", "page.text")
    rows = page.withColumn("i", F.row_number().over(Window.partitionBy("site").orderBy("page_id")) - 1).withColumn("batch", F.floor(F.col("i") / 25).cast("long"))
    entries = rows.select("site", "batch", F.col("i").alias("n"), curate.page_entry(F.col("i") % 25 + 1, "url", "title", "text").alias("entry"))
    return curate.prompts(entries)


@query("prompt_previews", f"""WITH {_TEXTS}, h AS (SELECT page_id, url, title, text, list_filter(string_split(title, ' '), lambda x: x <> '') AS heads FROM tx)
    SELECT page_id, '1. URL: ' || url || chr(10) || '   Title: ' || CASE WHEN title = '' THEN 'Untitled' ELSE title END || chr(10) || CASE WHEN text <> '' THEN '   Preview: ' || substring(text, 1, 200) || '...' || chr(10) ELSE '' END
      || CASE WHEN len(heads) > 0 THEN '   Sections: ' || array_to_string(heads[1:5], ', ') || chr(10) ELSE '' END || CASE WHEN text = '' AND len(heads) = 0 THEN '   Content: [EMPTY PAGE - NO CONTENT]' || chr(10) ELSE '' END AS entry FROM h""")
def prompt_previews(spark, d):
    """Entries of pages without content: the first paragraph and the first five of their headings, here the words of their titles."""
    page = pages(spark, d).select("page_id", "url", facts("html").alias("page")).select("page_id", "url", "page.title", "page.text", F.lit("").alias("none"))
    heads = page.withColumn("heads", F.filter(F.split("title", " "), lambda x: x != ""))
    return heads.select("page_id", curate.page_entry(F.lit(1), "url", "title", "none", "text", "heads").alias("entry"))


_HEADED = "list_filter(string_split(title, ' '), lambda x: x <> '')"


@query("prompt_headings", f"""WITH {_TEXTS}, h AS (SELECT page_id, url, title, {_HEADED} AS heads FROM tx)
    SELECT page_id, coalesce(heads[1], '') AS h1, '1. URL: ' || url || chr(10) || '   Title: ' || CASE WHEN title = '' THEN 'Untitled' ELSE title END || chr(10)
      || CASE WHEN len(heads) > 0 THEN '   Sections: ' || array_to_string(heads[1:5], ', ') || chr(10) ELSE '   Content: [EMPTY PAGE - NO CONTENT]' || chr(10) END AS entry FROM h""")
def prompt_headings(spark, d):
    """Entries of pages whose first five second-level headings stand for their content; each page gets its title's words as headings, with markup inside."""
    p = pages(spark, d).withColumn("title", facts("html")["title"])
    words = F.transform(F.filter(F.split("title", " "), lambda x: x != ""), lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))
    made = F.concat(F.lit("<body><h1> "), F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.lit("\n</h1>"), F.array_join(F.transform(words, lambda x: F.concat(F.lit("<h2 class=a>\t<b>"), x, F.lit("</b><script>x</script> </h2><h3>no</h3>"))), ""), F.lit("<h2> </h2></body>"))
    read = p.select("page_id", "url", "title", F.lit("").alias("none"), facts(made).alias("page")).select("page_id", "url", "title", "none", "page.h1", "page.h2s")
    return read.select("page_id", "h1", curate.page_entry(F.lit(1), "url", "title", "none", "none", "h2s").alias("entry"))


@query("prompt_changes", f"""WITH {SNAPSHOTS}, {_PAIRS}, c AS (SELECT p.site, a.url, old, new, row_number() OVER (PARTITION BY p.site ORDER BY p.page_id) - 1 AS n FROM p JOIN a ON p.page_id = a.page_id WHERE old <> new)
    SELECT site, n // 10 AS batch, string_agg((n % 10 + 1) || '. URL: ' || url || chr(10) || '   PREVIOUS CONTENT:' || chr(10) || CASE WHEN old = '' THEN '(no previous content)' WHEN length(old) > 800 THEN trim(substring(old, 1, 800)) || '...' ELSE trim(old) END
      || chr(10) || chr(10) || '   NEW CONTENT:' || chr(10) || CASE WHEN new = '' THEN '(no new content)' WHEN length(new) > 800 THEN trim(substring(new, 1, 800)) || '...' ELSE trim(new) END || chr(10), chr(10) || '---' || chr(10) ORDER BY n) AS prompt FROM c GROUP BY ALL""")
def prompt_changes(spark, d):
    from pyspark.sql import Window

    changed = _pairs(spark, d).where("old <> new").join(pages(spark, d).select("page_id", "url"), "page_id")
    rows = changed.withColumn("i", F.row_number().over(Window.partitionBy("site").orderBy("page_id")) - 1)
    entries = rows.select("site", F.floor(F.col("i") / 10).cast("long").alias("batch"), F.col("i").alias("n"), curate.change_entry(F.col("i") % 10 + 1, "url", "old", "new").alias("entry"))
    return curate.prompts(entries, "\n---\n")


@query("llm_json_parse", "SELECT conv_id, turn, role AS relevant, CAST(NULL AS VARCHAR) AS missing FROM conversations")
def llm_json_parse(spark, d):
    """Replies with a fenced JSON object that holds the role of each turn."""
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array("role").alias("relevant_urls"))), F.lit("\n```"))
    parsed = F.from_json(unfenced(reply), "struct<relevant_urls:array<string>,reasons:map<string,string>>")
    return table(spark, d, "conversations").select("conv_id", "turn", F.get(parsed["relevant_urls"], F.lit(0)).alias("relevant"), parsed["reasons"]["x"].alias("missing"))
