"""Rules against plain-Python models, boundaries and hand-made pages."""

import difflib
import hashlib
import html as html_lib
import random
import re
from urllib.parse import urljoin

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siteloom.functions import dom, html, text, timefmt, url
from siteloom.operators import change, curate, digest, links, schedule
from siteloom.sources import sitemap


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_url_forms(spark):
    rows = [("HTTP://H.org/A/", None), ("http://www.h.com/a//", "http://www.h.com/a"), ("http://h/p;v=1", "http://h/p"), ("http://h/?q#f", "http://h/"), ("https://h:80", "https://h:80/")]
    df = spark.createDataFrame([(u,) for u, _ in rows], "u string").select(url.page_key("u"))
    for (u, want), (got,) in zip(rows, df.collect(), strict=True):
        assert want is None or got == want, u


def test_format_errors(spark):
    want = {"ftp://h": "URL must use http:// or https://", "http://": "URL must include a domain name", "http://h": "Invalid domain name", "http://localhost:80/": None, "http://h.org": None}
    got = dict(spark.createDataFrame([(u,) for u in want], "u string").select("u", url.format_error("u")).collect())
    assert got == want


def test_resolution_matches_the_library(spark):
    cases = [(b, h) for b in ("http://h/a/b?x=1#f", "http://h", "https://h/a/") for h in ("c", "/r", "?q=2", "//o/z", "http://e/", "mailto:x@y", "../d", "./e/../f", "", "#g")]
    df = spark.createDataFrame(cases, "b string, h string").select("b", "h", dom.resolved("b", "h").alias("x"))
    assert [r.x for r in df.collect()] == [urljoin(b, h) for b, h in cases]
    odd = spark.createDataFrame([("http://[h/", "x"), (None, "x"), ("http://h", None)], "b string, h string")
    assert [r[0] for r in odd.select(dom.resolved("b", "h")).collect()] == [None, None, None]


def test_links_are_decoded_and_unquoted():
    page = """<a href=../y>1</a><A HREF='./z?a=1&amp;b=2' class=x>2</A><!-- <a href=no> --><script>"<a href=no>"</script><a name=x>3</a><a href>4</a><a href="">5</a><a title="a>b" href="/q">"""
    assert dom.link_targets("http://h/a/b/c", page) == [("../y", "http://h/a/y"), ("./z?a=1&b=2", "http://h/a/b/z?a=1&b=2"), ("", "http://h/a/b/c"), ("/q", "http://h/q")]


def test_crawl_follows_links_in_pages(spark):
    page = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    chain = [(f"http://h/{i}", page(f"./{i + 1}?a&amp;b#c", "/x.pdf", "http://o/0")) for i in range(60)]
    rows = [*chain, ("http://h/60", ""), ("http://h/x.pdf", ""), ("http://o/0", page("//o/1", "2/")), ("http://o/1", page("/0")), ("http://o/2", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    seeds = spark.createDataFrame([("http://h/0",), ("http://o/0",), ("http://gone/",)], "url string")
    found = {(r.node, r.depth) for r in links.crawl(df, seeds, 1000).collect()}
    assert found == {(f"http://h/{i}", i) for i in range(61)} | {("http://o/0", 0), ("http://o/1", 1), ("http://o/2", 1)}
    assert {(r.node, r.depth) for r in links.crawl(df, seeds, 2).collect()} == {("http://h/0", 0), ("http://h/1", 1), ("http://o/0", 0), ("http://o/1", 1)}


def test_sitemaps_of_any_depth(spark):
    index = lambda to: f"<sitemapindex><sitemap><loc>{to}</loc></sitemap></sitemapindex>"
    docs = [(str(i), index(i + 1)) for i in range(8)] + [("8", "<urlset><url><loc>http://h/p</loc></url></urlset>")]
    found = sitemap.urls(spark.createDataFrame(docs, "address string, xml string"), spark.createDataFrame([("0",)], "root string"))
    assert [(r.root, r.loc) for r in found.collect()] == [("0", "http://h/p")]


def test_skip_rules_are_substrings(spark):
    got = one(spark, url.is_skipped(F.lit("http://h/node.js-guide")), url.is_skipped(F.lit("http://h/f.woff2")), url.is_skipped(F.lit("http://h/f.woff2"), url.SKIP_DISCOVERY), url.is_skipped(F.lit("http://h/a.PDF")))
    assert got == (True, False, True, True)


#: Pages and their lines, worked out by hand from the rules.
PAGES = [
    ('<html><head><title> A &amp; B </title><meta content=" D  d " name=description><meta property="og:title" content="O"><meta property="og:description" content="P"></head><body><nav><a href="/x/?q=1">x</a><a href="#a">a</a><a href="/x">y</a></nav><main><p>Hello  <b>World</b></p></main></body></html>',
     "TITLE:a & b\nDESC:d d\nOG_TITLE:o\nOG_DESC:p\nCONTENT:hello world\nNAV:/x"),
    ("<html><head><title>T</title></head><body><article><p>Keep</p><script>no()</script><style>p{}</style><!-- no --></article></body></html>", "TITLE:t\nCONTENT:keep"),
    ("<title>\n T \n</title><body><div class='my cookie-banner'>a<div>b</div></div><p>x</p></body>", "TITLE:t\nCONTENT:x"),
    ("<title></title><body><main>a<div><main>b</main>c</div>d</main>e</body>", "TITLE:\nCONTENT:a b c d"),
    ("<body><div role=main>r</div><p>z&eacute;&hellip;</p></body>", "CONTENT:r z\u00e9\u2026"),
    ("<body><p>z</p><div id=main>m</div><div class='a content b'>c</div></body>", "CONTENT:m"),
    ("<body><header><a href='/h/'>h</a></header><p>z</p><nav><a href=/n>n</a><a href='javascript:x'>j</a><a href='/h'>h</a></nav></body>", "CONTENT:h z n j h\nNAV:/h,/n"),
    ("<p>no body</p>", ""),
    ("", ""),
]


def test_fingerprint_lines(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PAGES)] + [(99, None)], "i int, html string")
    got = {r.i: (r.t, r.h, r.f) for r in df.select("i", dom.semantic_text_of("html").alias("t"), dom.page_hash("html").alias("h"), dom.facts("html")["hash"].alias("f")).collect()}
    for i, (page, lines) in enumerate(PAGES):
        digest = hashlib.sha256(lines.encode()).hexdigest()
        assert got[i] == (lines, digest if page else "", digest)
    assert got[99] == (None, None, None)


def test_facts(spark):
    page = "<title>\n T &amp; u\n</title><meta name='description' content=' D '><body>direct<div role=main>r<script>s</script> <i class='modal'>m</i></div><p>z</p></body>"
    got = spark.createDataFrame([(page,), (None,)], "html string").select(dom.facts("html").alias("f")).select("f.*").collect()
    assert (got[0].title, got[0].description, got[0].og_title, got[0].text, got[0].visible, got[0].needs_render) == ("T & u", "D", "", "r m", len("r m z"), True)
    assert got[1].title is None and got[1].hash is None


def test_deep_nesting():
    deep = "<div>" * 10_000 + "x" + "</div>" * 10_000
    assert dom.semantic_text(f"<body>{deep}</body>") == "CONTENT:x"
    assert dom.markdown(f"<body>{deep}</body>") == "x" and dom.page_facts(f"<body>{deep}</body>")[4] == "x"


def test_tree_removes_boxes_that_patterns_keep():
    page = '<body><div class="head-nav">menu</div><div class="ad">ad</div><div data-tracking="1">t</div><article>x<div id="ad-1">y</div></article></body>'
    assert dom.semantic_text(page) == "CONTENT:x"
    assert dom.nav_links(dom.tree('<header><a href="/a/">1</a><a href="javascript:x">2</a></header>')) == ["/a"]


def test_markdown():
    page = '<main><h2>T</h2><p>a <b>b</b> <a href="/c">c</a><br>d</p><ul><li>x<li>y</ul><img src="i"><pre>k\n l</pre></main>'
    got = dom.markdown(page)
    assert "## T" in got and "**b**" in got and "[c](/c)" in got and "    k\n     l" in got and "i" not in got.split("k")[1]


def test_render_boundary(spark):
    body = lambda n: f"<body><p>{'x' * n}</p></body>"
    got = one(spark, *[dom.facts(F.lit(x))["needs_render"] for x in (body(499), body(500), body(600) + "Please enable JavaScript")])
    assert got == (True, False, True)
    assert dom.needs_render(body(499)) and not dom.needs_render(body(500))


def test_checked_title_decodes_after_the_cut(spark):
    page = "<title>" + "&amp;" * 50 + "</title>"
    assert one(spark, html.checked_title(F.lit(page)))[0] == html_lib.unescape(page[7:207])
    assert one(spark, html.checked_title(F.lit("<title><b>x</b></title>")))[0] is None


def test_references_need_their_semicolon(spark):
    """A title that is cut inside a reference keeps what is there; whole references are decoded once."""
    cut, whole = "a &amp;&amp; b&amp", "&amp;lt; &copy;&middot;&quot;&#39;&#x41; &notit; &am &quot &copy=2"
    page = f"<title>{cut}</title><body><p title='&copy=2'>{whole}</p></body>"
    got = spark.createDataFrame([(page,)], "html string").select(dom.facts("html")["title"].alias("t"), dom.facts("html")["text"].alias("x"), html.checked_title("html").alias("c")).first()
    assert (got.t, got.c, got.x) == ("a && b&amp", "a && b&amp", "&lt; ©·\"'A &notit; &am &quot &copy=2")
    assert dom.attributes("href='/x?a=1&copy=2&amp;b'") == {"href": "/x?a=1&copy=2&b"}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text("abcé\U0001f600", min_size=1, max_size=30), st.text("abcé\U0001f600", min_size=1, max_size=30)), min_size=1, max_size=8))
def test_diff_matches_difflib(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "page_id long, old string, new string")
    got = dict(change.diff_share(df).collect())
    for i, (a, b) in enumerate(pairs):
        r = min(len(a), len(b)) / max(len(a), len(b))
        want = (1 - r) * 100 if r < 0.5 else (1 - difflib.SequenceMatcher(None, a, b).quick_ratio()) * 100
        assert abs(got[i] - want) < 1e-6


def test_drift_boundaries(spark):
    rows = [(0, "", "x"), (1, "x" * 1000, "x" * 1300), (2, "x" * 1000, "x" * 1301), (3, "", ""), (4, "", "x" * 1001)]
    df = spark.createDataFrame(rows, "page_id long, old string, new string")
    assert [r[0] for r in df.select(change.length_changed("old", "new")).collect()] == [False, False, True, False, True]
    assert dict(change.drift_scores(df).collect())[0] == 0
    nav = lambda *h: "<nav>" + "".join(f'<a href="{x}">' for x in h) + "</nav>"
    pairs = [(nav(), nav(), False), (nav("/a"), nav(), True), (nav(*"abcde"), nav(*"abcdf"), True), (nav(*"abcdefghij"), nav(*"abcdefghik"), False)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "old string, new string")
    assert [r[0] for r in df.select(change.nav_changed("old", "new")).collect()] == [w for *_, w in pairs]


def test_regeneration_rules(spark):
    rows = [("a", 0, 9, 9, 9, 9, 9, "no_curated"), ("b", 10, 5, 5, 3, 2, 1, "within"), ("c", 10, 6, 0, 0, 2, 1, "removed"), ("d", 10, 0, 6, 0, 2, 1, "significant"), ("e", 10, 0, 0, 4, 2, 1, "expansion"), ("f", 10, 0, 0, 0, 2, 2, "sections")]
    df = spark.createDataFrame([r[:7] for r in rows], "site string, curated long, removed long, significant long, new_pages long, sections long, new_sections long")
    assert {r.site: r.reason for r in change.regeneration(df).collect()} == {r[0]: r[7] for r in rows}


def test_inventory_diff_parts_the_union(spark):
    a = spark.createDataFrame([("s", "1"), ("s", "2"), ("s", "2")], "site string, key string")
    b = spark.createDataFrame([("s", "2"), ("s", "3")], "site string, key string")
    assert {(r.key, r.status) for r in change.inventory_diff(a, b).collect()} == {("1", "removed"), ("2", "existing"), ("3", "new")}


def test_cooldown_ends_at_its_end(spark):
    checks = spark.createDataFrame([("a", 10, 5, False), ("b", 10, 5, False), ("c", 10, 0, False), ("d", 1000, 1, True), ("e", 100, 1, False)], "site string, total long, changed long, drift_significant boolean")
    ends = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:01")], "site string, t string").select("site", F.col("t").cast("timestamp").alias("expires"))
    got = dict(change.rescrape(checks, ends, F.lit("2024-01-01 00:00:00").cast("timestamp")).collect())
    assert got == {"a": "rescrape", "b": "cooling_down", "c": "reschedule", "d": "rescrape", "e": "reschedule"}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=20))
def test_backoff_model(spark, changes):
    df = spark.createDataFrame([("s", i, i, c) for i, c in enumerate(changes)], "site string, ts long, id long, changed boolean")
    got = [r.hours for r in schedule.backoff(df).orderBy("id").collect()]
    hours, want = 24, []
    for c in changes:
        hours = 6 if c else min(2 * hours, 168)
        want.append(hours)
    assert got == want and all(6 <= h <= 168 for h in got)


def test_lastmod_formats(spark):
    texts = ["2024-01-01", "2024-01-01T00:00:00", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00+0000", "2024-01-01T00:00:00.500+00:00", "garbage", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(timefmt.lastmod("t").isNotNull())
    assert [r[0] for r in df.collect()] == [True] * 5 + [False] * 2


def test_unfenced(spark):
    cases = {'{"a":1}': '{"a":1}', '```json\n{"a":1}\n```': '{"a":1}', '```\n{"a":1}': '{"a":1}'}
    got = dict(spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.unfenced("t")).collect())
    assert got == cases


DOCS = {
    "normal": "# T\n\n> tag\n\nover\nview\n\n---\n\n## A\n\nprose\n\n### Links\n\n- [x](http://x): d\n- no link\n\n---\n\n## B\n\n### LINKS\n- [y](http://y)\nafter\n\n---\n\nfooter",
    "no_tagline": "# T\n\nlost\n\n## A\n\np\n\n---\n\nend",
    "tagline_then_section": "# T\n> tag\n## A\nfirst\nsecond\n## B\nthird",
    "rule_before_h3": "# T\n\n> t\n\n## A\n\n---\n\n### x ## y\n\ntext\n\n---",
    "before_title": "junk\n## Early\np\n# T\n> g\no",
    "empty": "",
}


#: Title, tagline, overview and (name, prose, links) of each section.
PARSED = {
    "normal": ("T", "tag", "over\nview", [("A", "prose", 1), ("B", "", 1)]),
    "no_tagline": ("T", "", "", [("A", "p", 0)]),
    "tagline_then_section": ("T", "tag", "first\nsecond", [("A", "", 0), ("B", "third", 0)]),
    "rule_before_h3": ("T", "t", "", [("A", "### x ## y\n\ntext", 0)]),
    "before_title": ("T", "g", "o", [("Early", "p", 0)]),
    "empty": ("", "", "", []),
}


def test_parser_on_odd_documents(spark):
    docs = spark.createDataFrame(list(DOCS.items()), "site string, content string")
    lines = digest.parse_lines(docs)
    heads = {r.site: (r.title, r.tagline, r.overview) for r in digest.parsed_overviews(lines).collect()}
    sections = {}
    for r in digest.parsed_sections(lines).orderBy("site", "section").collect():
        sections.setdefault(r.site, []).append((r.name, r.prose, r.n_links))
    assert {name: (*heads[name], sections.get(name, [])) for name in DOCS} == PARSED


def test_homepages_and_failed_batches(spark):
    rows = spark.createDataFrame([("s", 1, "http://s/", True), ("s", 2, "http://s/", True), ("s", 3, "http://s/page/2", False)], "site string, page_id long, url string, is_homepage boolean")
    assert {r.page_id for r in curate.one_homepage(rows).collect()} == {1, 3}
    batched = curate.batches(rows)

    def broken(_):
        raise RuntimeError

    assert curate.kept_by_replies(batched, curate.replies(batched, broken)).count() == 3
    assert {r.page_id for r in curate.kept_by_replies(batched, curate.replies(batched)).collect()} == {1, 2}


def test_frontier_ends_in_cycles(spark):
    edges = spark.createDataFrame([("s", 1, 2), ("s", 2, 3), ("s", 3, 1), ("t", 1, 9)], "site string, src long, dst long")
    seeds = spark.createDataFrame([("s", 1), ("t", 1)], "site string, node long")
    found = links.frontier(edges, seeds)
    assert sorted(map(tuple, found.collect())) == [("s", 1, 0), ("s", 2, 1), ("s", 3, 2), ("t", 1, 0), ("t", 9, 1)]
    assert links.within_budget(found, 2).count() == 4


def test_site_crawl_source(spark, tmp_path):
    from urllib.parse import quote

    from siteloom.sources import site_crawl

    (tmp_path / quote("http://h/a", safe="")).write_text("<p>x</p>")
    site_crawl.register(spark)
    df = spark.read.format("site_crawl").option("urls", "http://h/a http://h/b").option("folder", str(tmp_path)).option("per_task", "1").load()
    assert {tuple(r) for r in df.collect()} == {("http://h/a", "<p>x</p>", 200), ("http://h/b", None, 404)}


def test_site_crawl_follows_links(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import quote

    from siteloom.sources import site_crawl

    pages = {"http://h/": '<a href="/a?x=1">a</a><a href="b/">b</a><a href="http://o/">o</a><a href="/x.pdf">p</a>', "http://h/a": '<a href="/">h</a><a href="c">c</a>', "http://h/b": "b", "http://h/c": "c"}
    for address, html_ in pages.items():
        (tmp_path / quote(address, safe="")).write_text(html_)
    site_crawl.register(spark)
    read = spark.read.format("site_crawl").option("urls", "http://h/ http://gone/").option("folder", str(tmp_path)).option("follow", "true")
    got = {(r.url, r.status, r.depth) for r in read.load().collect()}
    assert got == {("http://h/", 200, 0), ("http://h/a", 200, 1), ("http://h/b", 200, 1), ("http://h/c", 200, 2), ("http://gone/", 404, 0)}
    assert {r.url for r in read.option("max_pages", "2").load().collect()} == {"http://h/", "http://h/a", "http://gone/"}

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/a" else 404)
            self.end_headers()
            self.wfile.write("<p>é</p>".encode())

        def do_POST(self):
            asked = self.rfile.read(int(self.headers["Content-Length"])).decode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(('{"html": "for ' + asked.replace('"', "'") + '"}').encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        assert site_crawl.from_site(f"{at}/a", {}) == ("<p>é</p>", 200) and site_crawl.from_site(f"{at}/b", {})[1] == 404
        assert site_crawl.from_service("http://x/", {"endpoint": at}) == ("for {'url': 'http://x/'}", 200)
    finally:
        server.shutdown()
        server.server_close()
    assert site_crawl.from_site(f"{at}/a", {"timeout": "1"}) == (None, 0)


def test_dispatch_runs_and_bold(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(0, 3000) if i % 3 else 600) for i in range(120)]
    df = spark.createDataFrame(rows, "site long, at long").select("site", F.timestamp_seconds("at").alias("run_at"))
    got = {r.site: r.run for r in schedule.dispatch_runs(df, 3, 60).collect()}
    waiting, want = sorted((at, site) for site, at in rows), {}
    for run in range(200):
        due = [x for x in waiting if x[0] <= 60 * run][:3]
        want |= {site: run for _, site in due}
        waiting = [x for x in waiting if x not in due]
    assert got == want
    parts = one(spark, text.bold_parts(F.lit("a **b** c**d**")), text.bold_parts(F.lit("****")), text.bold_parts(F.lit("")))
    assert [[(p.bold, p.text) for p in x] for x in parts] == [[(False, "a "), (True, "b"), (False, " c"), (True, "d")], [(True, "")], []]


def test_progress_expires_in_a_stream(spark, tmp_path):
    import datetime

    from siteloom.streaming import state

    at = lambda m: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(minutes=m)
    batches = [[(1, at(0), 1), (2, at(5), 2)], [(1, at(50), 3)], [(3, at(240), 4)], [(3, at(242), 5)]]
    schema = "site long, ts timestamp, id long"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([], schema).write.mode("append").parquet(str(tmp_path / "in"))
    found = state.drained(state.expiring_progress_stream(state.event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)), "expiring").collect()
    assert sorted((r.site, r.id) for r in found if r.kind == "expired") == [(1, 3), (2, 2)]
    assert (3, 5) in {(r.site, r.id) for r in found if r.kind == "set"}


def test_parser_in_one_pass_equals_its_definition(spark):
    """Random documents line by line: the fold against what each kind is defined as, over the whole document."""
    rng = random.Random(12)
    some = ["# T", "## S", "### Links", "### LINKS ", " ## in", "> q", "---", "--- x", "- [a](b)", "- [a](b): c", "- x", "", "  ", "text", "x ## y", "- [a]b](c)", "\u3000"]
    docs = ["\n".join(rng.choices(some, k=rng.randrange(1, 25))) for _ in range(400)] + ["", "\n"]
    for doc in docs:
        lines = doc.split("\n")
        s = [x.strip(" ") for x in lines]
        at = range(len(lines))
        first = lambda ok: next((n for n in at if ok(n)), None)
        title = first(lambda n: s[n].startswith("# "))
        tagline = first(lambda n: title is not None and n > title and s[n].startswith("> "))
        heads = [n for n in at if "## " in lines[n]]
        footer = first(lambda n: s[n].startswith("---") and n >= max(heads, default=-1))
        for n, line, t, kind, section in digest.read_lines(doc):
            assert (line, t, section) == (lines[n], s[n], sum(x.startswith("## ") for x in s[: n + 1]))
            assert (kind == "footer") == (footer is not None and n > footer) and (kind == "title") == (n == title and kind != "footer")
            if kind == "tagline":
                assert n == tagline
            if kind == "link":
                assert section and any(x.lower() == "### links" for x in s[:n]) and re.search(r"^-\s*\[([^\]]+)\]\(([^)]+)\)(?::\s*(.*))?$", t)
            if kind == "overview":
                assert tagline is not None and n > tagline
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)] + [(None, None)], "site long, content string")
    spark.udtf.register("digest_lines", digest.DigestLines)
    df.createOrReplaceTempView("some_docs")
    by_sql = spark.sql("SELECT site, n, line, s, kind, section FROM some_docs, LATERAL digest_lines(content)")
    assert sorted(map(tuple, by_sql.collect())) == sorted(map(tuple, digest.parse_lines(df).collect())) == sorted((i, *x) for i, d in enumerate(docs) for x in digest.read_lines(d))


def test_headings():
    page = "<body><h1> </h1><h1>One <b>and</b>\n two</h1><h2>a</h2><div><h2><script>x</script>b &amp; c</h2></div><h2></h2><h3>no</h3></body>"
    found = dict(zip(dom.FACTS.names, dom.page_facts(page), strict=True))
    assert found["h1"] == "One and two" and found["h2s"] == ["a", "b & c"]


def test_large_sitemaps_are_read_by_several_tasks(spark, tmp_path):
    import gzip

    entry = lambda i: f"<url>\n  <loc> http://h/{i % 30_000}?a&amp;b={i} </loc><lastmod>2024-01-{i % 28 + 1:02d}</lastmod>{'<priority>1</priority>' * (i % 3)}</url>\n"
    body = "".join(entry(i) for i in range(40_000))
    text_ = f'<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{body}<url><lastmod>2024</lastmod></url></urlset>'
    (tmp_path / "big.xml").write_text(text_)
    (tmp_path / "packed.xml.gz").write_bytes(gzip.compress(text_[:9000].rsplit("<url>", 1)[0].encode() + b"</urlset>"))
    (tmp_path / "index.xml").write_text("<sitemapindex><sitemap><loc>a</loc></sitemap>\n<sitemap ><loc>b</loc></sitemap></sitemapindex>")
    (tmp_path / "odd.xml").write_text("no XML </url> <url><loc>broken</url>")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(512 << 10))
    try:
        found = sitemap.read_split(spark, str(tmp_path)).withColumn("name", F.regexp_extract("address", "[^/]+$", 0)).withColumn("block", F.col("ord.block"))
        rows = found.orderBy("name", "kind", "ord").collect()
    finally:
        spark.conf.set(key, before)
    of = lambda name: [(r.kind, r.loc, r.lastmod) for r in rows if r.name == name]
    want = sitemap.entries(spark.createDataFrame([("x", text_)], "address string, xml string")).orderBy("ord").collect()
    assert of("big.xml") == [(r.kind, r.loc, r.lastmod) for r in want] and len(want) == 40_000
    assert len({r.block for r in rows if r.name == "big.xml"}) > 4
    assert of("packed.xml.gz") == of("big.xml")[: len(of("packed.xml.gz"))] and len(of("packed.xml.gz")) > 50
    assert of("index.xml") == [("sitemap", "a", None), ("sitemap", "b", None)] and of("odd.xml") == []


def test_marks_inside_bold_lines_and_odd_spaces(spark):
    from siteloom.functions.text import bold_parts, normal

    lines = ["a\u0001b**c\u0001d**\u0002\u0002a**e**", "**x**", "plain", "", "\u0002b**\u0002**"]
    got = [[(p.bold, p.text) for p in r.p] for r in spark.createDataFrame([(x,) for x in lines], "t string").select(bold_parts("t").alias("p")).collect()]
    assert got == [[(False, "a\u0001b"), (True, "c\u0001d"), (False, "\u0002\u0002a"), (True, "e")], [(True, "x")], [(False, "plain")], [], [(False, "\u0002b"), (True, "\u0002")]]
    assert one(spark, normal(F.lit("A\u3000\u00a0 b\n"))) == ("a b",)


def test_links_of_one_address_go_by_their_number(spark):
    """Pages 9 and 10 share an address: by number, not by what their lines say; without a number by the lines."""
    heads = spark.createDataFrame([("s", "s", "", "")], "site string, title string, tagline string, overview string")
    sections = spark.createDataFrame([("s", 1, "A", "")], "site string, ord long, name string, prose string")
    rows = spark.createDataFrame([("s", "A", "t", "http://s/x", f"Page {n}", n) for n in (10, 9)], "site string, section string, title string, url string, description string, ord long")
    places = lambda df: [x[-2:] for x in digest.assemble(heads, sections, df).first().content.split("\n") if x.startswith("- ")]
    assert places(rows) == [" 9", "10"] and places(rows.drop("ord")) == ["10", " 9"]


def test_pages_are_read_a_few_at_a_time():
    """Facts of a batch equal those of each page for itself, whatever the batch; only a few pages are strings at once."""
    import pyarrow as pa

    read = []
    half = dom._each(lambda x: read.append(x) or x[:1], dom.T.StringType()).func
    pages = [None, *(f"{n % 70}" for n in range(300)), None]
    assert half(pa.array(pages)).to_pylist() == [x and x[:1] for x in pages] and len(read) > 70
    assert half(pa.array([], pa.string())).to_pylist() == []
    got = dom.facts.func(pa.array([None, "<title>a</title>"])).to_pylist()
    assert got[0] is None and got[1]["title"] == "a" and dom.title_of.func(pa.array(["<title>a &amp; b</title>"])).to_pylist() == ["a & b"]
