"""Queries on the digest: assembly, parsing, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom import api
from siteloom.functions.text import bold_parts, line_kind
from siteloom.operators import digest, versions
from siteloom.plans.base import HOST, query, sql_title, table
from siteloom.plans.changes import _NAMES, sectioned
from siteloom.storage import new_path

_PROSE = "'About ' || section || ' on ' || site || '.' || chr(10) || 'Second line.'"
_FOOT = "'This document helps AI systems understand ' || site || '''s purpose and offerings.'"
_RANK = "coalesce(nullif(list_position(['Platform Features','Solutions','Integrations','Resources','Pricing','Company','Other'], section), 0), 999)"
_LINKABLE = "replace(lower(site), 'www.', '') || rtrim(regexp_extract(url, '^https?://[^/?#]+([^?#;]*)', 1), '/') <> site"
_BASE = f"""sp AS (SELECT page_id, {HOST} AS site, url, {sql_title('html')} AS title, {_NAMES} AS section FROM pages),
    sn AS (SELECT site, section, min(page_id) AS ord FROM sp GROUP BY ALL),
    li AS (SELECT site, section, string_agg('- [' || title || '](' || url || '): Page ' || page_id, chr(10) ORDER BY url, page_id) AS links FROM sp WHERE {_LINKABLE} GROUP BY ALL),
    bl AS (SELECT site, section, ord, {_RANK} AS rank, '## ' || section || chr(10) || chr(10) || {_PROSE} || chr(10) || chr(10) || coalesce('### Links' || chr(10) || chr(10) || links || chr(10) || chr(10), '') AS block FROM sn LEFT JOIN li USING (site, section)),
    dg AS (SELECT site, '# ' || site || chr(10) || chr(10) || '> Pages of ' || site || chr(10) || chr(10) || 'All pages.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg(block, '---' || chr(10) || chr(10) ORDER BY rank, ord) || '---' || chr(10) || chr(10) || {_FOOT} AS content FROM bl GROUP BY site)"""


def _parts(spark, d):
    rows = sectioned(spark, d).withColumn("description", F.concat(F.lit("Page "), F.col("page_id").cast("string"))).withColumn("ord", F.col("page_id"))
    prose = F.concat(F.lit("About "), F.col("name"), F.lit(" on "), F.col("site"), F.lit(".\nSecond line."))
    sections = rows.groupBy("site", F.col("section").alias("name")).agg(F.min("page_id").alias("ord")).withColumn("prose", prose)
    heads = rows.select("site").distinct().select("site", F.col("site").alias("title"), F.concat(F.lit("Pages of "), "site").alias("tagline"), F.lit("All pages.").alias("overview"))
    return heads, sections, rows


def _digests(spark, d):
    return digest.assemble(*_parts(spark, d))


@query("digest_assemble", f"WITH {_BASE} SELECT * FROM dg")
def digest_assemble(spark, d):
    return _digests(spark, d)


@query("digest_hash", f"WITH {_BASE} SELECT site, sha256(content) AS hash, length(content)::BIGINT AS n_chars FROM dg")
def digest_hash(spark, d):
    return _digests(spark, d).select("site", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), F.length("content").cast("long").alias("n_chars"))


@query("digest_assemble_flat", f"""WITH {_BASE}, fb AS (SELECT site, section, min(page_id) AS ord, {_RANK} AS rank, '## ' || section || chr(10) || chr(10) || '### Links' || chr(10) || chr(10) || string_agg('- [' || title || '](' || url || '): Page ' || page_id, chr(10) ORDER BY url, page_id) || chr(10) || chr(10) AS block FROM sp WHERE {_LINKABLE} GROUP BY site, section)
    SELECT site, '# ' || site || chr(10) || chr(10) || '> Pages of ' || site || chr(10) || chr(10) || 'All pages.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg(block, '---' || chr(10) || chr(10) ORDER BY rank, ord) || '---' || chr(10) || chr(10) || {_FOOT} AS content FROM fb GROUP BY site""")
def digest_assemble_flat(spark, d):
    heads, _, rows = _parts(spark, d)
    return digest.assemble_flat(heads, rows)


@query("digest_parse_links", f"WITH {_BASE}, o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY rank, ord) AS nth FROM bl) SELECT sp.site, nth::BIGINT AS section, url, trim(title) AS title, 'Page ' || page_id AS description FROM sp JOIN o ON sp.site = o.site AND sp.section = o.section WHERE {_LINKABLE.replace('site', 'sp.site')} AND title <> '' AND NOT contains(title, ']')")
def digest_parse_links(spark, d):
    """Links of the parsed digests; a title with a bracket is no link to the parser."""
    return digest.parsed_links(digest.parse_lines(_digests(spark, d))).select("site", "section", "url", "title", "description")


@query("digest_parse_sections", f"""WITH {_BASE}, o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY rank, ord) AS nth FROM bl),
    n AS (SELECT site, section, count(*) AS n_links FROM sp WHERE {_LINKABLE} AND title <> '' AND NOT contains(title, ']') GROUP BY ALL)
    SELECT site, nth::BIGINT AS section, o.section AS name, {_PROSE.replace('section', 'o.section')} AS prose, coalesce(n_links, 0) AS n_links FROM o LEFT JOIN n USING (site, section)""")
def digest_parse_sections(spark, d):
    return digest.parsed_sections(digest.parse_lines(_digests(spark, d)))


@query("digest_lines_sql", f"WITH {_BASE} SELECT site, count(*) FILTER (t LIKE '## %') AS n_sections, count(*) AS n_lines FROM (SELECT site, unnest(string_split(content, chr(10))) AS t FROM dg) GROUP BY site")
def digest_lines_sql(spark, d):
    """The parser as a table function of SQL."""
    spark.udtf.register("digest_lines", digest.DigestLines)
    _digests(spark, d).createOrReplaceTempView("_digests_to_parse")
    return spark.sql("SELECT site, count_if(kind = 'section') AS n_sections, count(*) AS n_lines FROM _digests_to_parse, LATERAL digest_lines(content) GROUP BY site")


@query("digest_parse_overview", f"WITH {_BASE} SELECT site, site AS title, 'Pages of ' || site AS tagline, 'All pages.' AS overview FROM dg")
def digest_parse_overview(spark, d):
    return digest.parsed_overviews(digest.parse_lines(_digests(spark, d)))


_MERGED = "string_agg({0}, '' ORDER BY rank, ord)"


@query("digest_merge", f"""WITH {_BASE}, ml AS (SELECT site, section, string_agg('- [' || trim(title) || '](' || url || '): Page ' || page_id, chr(10) ORDER BY url, page_id) AS links FROM sp WHERE {_LINKABLE} AND title <> '' AND NOT contains(title, ']') GROUP BY ALL),
    mb AS (SELECT site, rank, ord, '## ' || section || chr(10) || chr(10) || CASE WHEN section = 'Resources' THEN 'New text.' || chr(10) || chr(10) || '### Links' || chr(10) || chr(10) || '- [New](http://new/)' || chr(10) || chr(10) ELSE {_PROSE} || chr(10) || chr(10) || coalesce('### Links' || chr(10) || chr(10) || links || chr(10) || chr(10), '') END AS block
      FROM bl LEFT JOIN ml USING (site, section) WHERE section <> 'Guides')
    SELECT dg.site, '# ' || dg.site || chr(10) || chr(10) || '> Pages of ' || dg.site || chr(10) || chr(10) || 'All pages.' || chr(10) || chr(10) || coalesce(body, '') || '---' || chr(10) || chr(10) || {_FOOT.replace("site ||", "dg.site ||")} AS content
    FROM dg LEFT JOIN (SELECT site, {_MERGED.format('block')} AS body FROM mb GROUP BY site) m ON dg.site = m.site""")
def digest_merge(spark, d):
    """Resources are regenerated, Guides dropped, the rest kept."""
    lines = digest.parse_lines(_digests(spark, d))
    names = digest.parsed_sections(lines).select("site", "name")
    new = names.where("name = 'Resources'").select("site", "name", F.lit("New text.").alias("prose"), F.lit("- [New](http://new/)").alias("links"))
    return digest.merge(lines, new, names.where("name NOT IN ('Resources', 'Guides')"))


@query("digest_roundtrip", f"WITH {_BASE} SELECT site, true AS same FROM dg")
def digest_roundtrip(spark, d):
    """Digests of titles without brackets, parsed, assembled again and compared."""
    heads, sections, rows = _parts(spark, d)
    safe = rows.withColumn("title", F.regexp_replace(F.concat(F.lit("T "), F.col("title")), r"[\[\]\s]+", " ")).withColumn("title", F.trim("title"))
    first = digest.assemble(heads, sections, safe)
    lines = digest.parse_lines(first)
    parsed = digest.parsed_sections(lines)
    linked = digest.parsed_links(lines).join(parsed.select("site", "section", F.col("name")), ["site", "section"]).select("site", F.col("name").alias("section"), "title", "url", "description", F.col("n").alias("ord"))
    second = digest.assemble(digest.parsed_overviews(lines), parsed.select("site", F.col("section").alias("ord"), "name", "prose"), linked)
    return first.join(second.withColumnRenamed("content", "again"), "site").select("site", (F.col("content") == F.col("again")).alias("same"))


@query("line_classify", f"""WITH {_BASE}, t AS (SELECT site, unnest(string_split(content, chr(10))) AS t FROM dg)
    SELECT site, CASE WHEN t LIKE '# %' THEN 'h1' WHEN t LIKE '### %' THEN 'h3' WHEN t LIKE '## %' THEN 'h2' WHEN trim(t) = '---' THEN 'rule' WHEN t LIKE '> %' THEN 'quote'
      WHEN regexp_matches(t, '^- \\[[^\\]]+\\]\\([^)]+\\)') THEN 'link' WHEN t LIKE '- %' THEN 'bullet' WHEN trim(t) = '' THEN 'blank' ELSE 'para' END AS kind, count(*) AS n FROM t GROUP BY ALL""")
def line_classify(spark, d):
    lines = _digests(spark, d).select("site", F.explode(F.split("content", "\n")).alias("line"))
    return lines.groupBy("site", line_kind("line").alias("kind")).agg(F.count("*").alias("n"))


@query("bold_split", "SELECT doc_id, lang AS first, CASE WHEN source LIKE '%*%' THEN NULL ELSE source END AS bold, 3 AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND source <> '' AND lang <> '' AND NOT contains(source, '*')")
def bold_split(spark, d):
    """A line of each document's language, its source in bold, and an odd end."""
    docs = table(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL AND source <> '' AND lang <> '' AND NOT contains(source, '*')")
    parts = docs.select("doc_id", bold_parts(F.concat("lang", F.lit("**"), "source", F.lit("** and **"))).alias("p"))
    return parts.select("doc_id", F.col("p")[0]["text"].alias("first"), F.when(F.col("p")[1]["bold"], F.col("p")[1]["text"]).alias("bold"), F.size("p").alias("n"))


@query("digest_download", f"WITH {_BASE} SELECT site, unnest(string_split(content, chr(10))) AS line FROM dg")
def digest_download(spark, d):
    """Digests written as text files, a folder a site, and read back by line."""
    path = new_path(spark, "digests")
    api.download(_digests(spark, d), path)
    return spark.read.text(path).select("site", F.col("value").alias("line"))


@query("sections_update", f"""WITH {_BASE} SELECT site, section AS name, CASE WHEN section = 'Resources' THEN 'New text.' ELSE 'Old text.' END AS description,
    count(*) AS n_pages FROM sp WHERE section <> 'Guides' GROUP BY ALL""")
def sections_update(spark, d):
    """Resources get new text, Guides are dead and go with their pages."""
    rows = sectioned(spark, d).select("site", F.col("section").alias("category"), "page_id")
    held = rows.select("site", F.col("category").alias("name")).distinct().withColumn("description", F.lit("Old text."))
    new = held.where("name = 'Resources'").withColumn("description", F.lit("New text."))
    gone = held.where("name = 'Guides'")
    pages = versions.without_sections(rows, gone).groupBy("site", F.col("category").alias("name")).agg(F.count("*").alias("n_pages"))
    return versions.updated_sections(held, new, gone).join(pages, ["site", "name"])
