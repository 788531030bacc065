"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"
_ESC = r"regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')"

OP4 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
h AS (SELECT digest, max(page_id) AS head FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest, CASE WHEN head IS NULL OR head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN h ON p.digest = h.digest AND n >= 1000"""

OP6 = """
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '<[^>]*$', '') AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'), '\\s*</?(p|h1)>\\s*', chr(10), 'g') AS x FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(string_split(x, chr(10)), lambda l: trim(regexp_replace(regexp_replace(replace(replace(l, '&quot;', '"'), '&amp;', chr(1)), '&amp$', chr(1)), '\\s+', ' ', 'g'))), lambda l: l <> '') AS x FROM b),
d AS (SELECT page_id, url, replace(array_to_string(x, chr(10)), chr(1), '&') AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d"""

OP7 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(12 + length(role) + 1 + length({_ESC}) + 11) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM g"""

OP8 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD}))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT *, [4.5, 0.5, 2.0][nth % 3 + 1]::DOUBLE AS w0, [-3.0, 1.0, 0.0][nth % 3 + 1]::DOUBLE AS slope, [3.0, 1.0, 2.0][nth % 3 + 1]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, nth) AS place FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
m AS (SELECT *, min_by(level, place) FILTER (level * weight <= cap) OVER () AS least_level FROM l),
t AS (SELECT source, source_size, weight, w0, slope, coalesce(least(least_level * weight, cap), cap) AS target FROM m),
c AS (SELECT d.*, t.source_size, t.target, weight, w0, slope, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS passes,
  (size * 20 <= t.source_size)::INT + (size * 100 <= t.source_size)::INT + (size * 400 <= t.source_size)::INT AS kind FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, target - passes * source_size AS part, sum(size) OVER (PARTITION BY source, kind) AS mass, sum(size) OVER (PARTITION BY source ORDER BY kind RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
  coalesce(sum(size) OVER (PARTITION BY source, kind ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS middle FROM c),
k0 AS (SELECT source, sum(size) AS n FROM b WHERE kind = 0 AND middle < part * mass / greatest(rest, 1) GROUP BY source),
k1 AS (SELECT b.source, sum(size) AS n FROM b LEFT JOIN k0 ON b.source IS NOT DISTINCT FROM k0.source WHERE kind = 1 AND middle < (part - coalesce(k0.n, 0)) * mass / greatest(rest, 1) GROUP BY b.source),
k2 AS (SELECT b.source, sum(size) AS n FROM b LEFT JOIN k0 ON b.source IS NOT DISTINCT FROM k0.source LEFT JOIN k1 ON b.source IS NOT DISTINCT FROM k1.source WHERE kind = 2 AND middle < (part - coalesce(k0.n, 0) - coalesce(k1.n, 0)) * mass / greatest(rest, 1) GROUP BY b.source),
p AS (SELECT b.*, (part - CASE WHEN kind > 0 THEN coalesce(k0.n, 0) ELSE 0 END - CASE WHEN kind > 1 THEN coalesce(k1.n, 0) ELSE 0 END - CASE WHEN kind > 2 THEN coalesce(k2.n, 0) ELSE 0 END) * mass / greatest(rest, 1) AS share
  FROM b LEFT JOIN k0 ON b.source IS NOT DISTINCT FROM k0.source LEFT JOIN k1 ON b.source IS NOT DISTINCT FROM k1.source LEFT JOIN k2 ON b.source IS NOT DISTINCT FROM k2.source),
z AS (SELECT *, passes + CASE WHEN middle < share THEN 1 ELSE 0 END AS copies, passes * mass + least(greatest(share, 0), mass) AS demand FROM p),
y AS (SELECT *, weight * CASE WHEN demand > 0 THEN middle / demand ELSE ('0x' || substring(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE END AS asked FROM z)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken,
  CASE WHEN copies > 0 THEN round(CASE WHEN asked <= 0 THEN 0 ELSE least(2 * asked / (w0 + sqrt(greatest(0, w0 * w0 + 2 * slope * asked))), 1) END, 6) END AS position FROM y"""

_BINS = "[{'m': 'word_length', 'bin': least(4000, 20 * word_chars // n_words)}, {'m': 'symbols', 'bin': 1000 * n_symbols // word_chars}, {'m': 'dup_lines', 'bin': least(4000, 1000 * n_dup_lines // n_words)}, {'m': 'repeats', 'bin': 1000 * n_repeat_words // n_words}]"
_QUARTS = "{0} AS (SELECT {1} m, max(total) AS total, min(bin) FILTER (4 * upto >= total) AS q1, min(bin) FILTER (4 * upto >= 2 * total) AS q2, min(bin) FILTER (4 * upto >= 3 * total) AS q3 FROM (SELECT *, sum(n) OVER (PARTITION BY {1} m ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {1} m) AS total FROM (SELECT {1} m, bin, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY ALL)"
_STEP = "CASE f.m WHEN 'word_length' THEN 2 WHEN 'dup_lines' THEN 20 WHEN 'repeats' THEN 50 ELSE 5 END"

OP9 = f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, {_WORD}) AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS lines FROM t),
x AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM x), (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
f0 AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
e AS (SELECT doc_id, lang, source, b.m AS m, b.bin AS bin FROM (SELECT *, unnest({_BINS}) AS b FROM f0 WHERE NOT base_failed)),
sk AS (SELECT lang, source, m, bin, count(*) AS n FROM e GROUP BY ALL),
{_QUARTS.format('own', 'lang, source,')},
{_QUARTS.format('byl', 'lang,')},
{_QUARTS.format('ovr', '')},
lim AS (SELECT f.lang, f.source, f.m, CASE WHEN f.total >= 100 THEN f.q2 WHEN g.total >= 100 THEN g.q2 ELSE o.q2 END AS mid,
  6 * ({_STEP} + CASE WHEN f.total >= 100 THEN f.q3 - f.q1 WHEN g.total >= 100 THEN g.q3 - g.q1 ELSE o.q3 - o.q1 END) AS wide
  FROM own f JOIN byl g ON f.lang IS NOT DISTINCT FROM g.lang AND f.m = g.m JOIN ovr o ON f.m = o.m),
v AS (SELECT e.doc_id, bool_and(bin <= mid + wide AND (e.m <> 'word_length' OR bin >= mid - wide)) AS ok FROM e JOIN lim ON e.lang IS NOT DISTINCT FROM lim.lang AND e.source IS NOT DISTINCT FROM lim.source AND e.m = lim.m GROUP BY e.doc_id)
SELECT f0.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN false ELSE coalesce(ok, true) END AS kept FROM f0 LEFT JOIN v USING (doc_id)"""

_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_RULE = "CASE " + " ".join(f"WHEN {_FITS.format(h, p)} THEN '{h}{p}'" for h, p in (("example.org", "/en/1"), ("example.org", "/es/"), ("com", "/fr/"), ("com", "/de/"), ("org", "/"))) + " END"

OP10 = f"""
WITH p AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages), r AS (SELECT *, {_RULE} AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN host || path IN (SELECT host || path FROM p WHERE regexp_matches(url, '^[^?#]*\\?([^#]*&)?utm_source=')) THEN 'block' ELSE 'allow' END AS verdict FROM r"""

OP11 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS n FROM s WHERE same),
g AS (SELECT p.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score WHERE n <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM g WHERE rank <= 5"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""
WITH t AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
u AS (SELECT doc_id, len(terms)::BIGINT AS n FROM t), s AS (SELECT count(*) FILTER (n > 0) AS docs, sum(n)::BIGINT AS words FROM u),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM t) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
d AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM d, s),
m AS (SELECT doc_id, 50 + (50 * n * docs) // words AS scale FROM u, s WHERE n > 0),
r AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * scale)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 50"""

ORACLES: dict[str, str] = {
    "op4_warc_archives": OP4,
    "op6_html_main_text": OP6,
    "op7_chat_formatting": OP7,
    "op8_source_mixing": OP8,
    "op9_quality_rules": OP9,
    "op10_url_filters": OP10,
    "op11_hard_negatives": OP11,
    "op13_lexical_search": OP13,
}
