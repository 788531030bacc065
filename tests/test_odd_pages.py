"""Page queries against their SQL twins on pages that the tables lack or rarely have."""

import pytest
from conftest import same_rows

from siteloom.plans import ORACLES, QUERIES

PAGE = "<html><head><title>{}</title></head><body><nav><a href='/a?x=1'>A</a></nav><article><p>{}</p></article></body></html>"
WHOLE = ("a &amp; b", "x&quot;", "&copy;", "&middot; m", "&lt;b&gt;", "&#39;q", "&amp;lt;", "&amp;amp;")
#: Titles and texts cut at each place of a reference, and whole ones.
CUT = [PAGE.format("T " + w[:n], "text " + w[:n]) for w in WHOLE for n in range(len(w) + 1)]


def odd_pages(folder, htmls):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = range(len(htmls))
    pq.write_table(pa.table({"page_id": list(n), "url": [f"https://s{i % 3}.org/en/{i}" for i in n], "html": pa.array(htmls, pa.string())}), f"{folder}/pages.parquet")
    return str(folder)


def same_as_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet')")
    mine, theirs = same_rows(QUERIES[name](spark, folder), con.sql(ORACLES[name]))
    return bool(mine) and mine == theirs


@pytest.mark.parametrize("name", ["page_main_text", "page_fingerprint", "page_fingerprint_exact", "page_content_hash", "digest_parse_links"])
def test_cut_and_missing_pages(spark, tmp_path, name):
    assert same_as_sql(spark, odd_pages(tmp_path, [*CUT, "", None]), name)


def test_a_title_is_read_no_further_than_it_needs(monkeypatch):
    """What follows a whole title is left unread, and the title is that of the whole page."""
    import random

    from siteloom.functions import dom

    whole = lambda h: dom.title(list(dom.tree(h).walk()))
    early = lambda h: dom.title_of.func(dom.pa.array([h]))[0].as_py()
    parts = ["<title>", "</title>", "<title/>", "<TITLE x='</title>'>", "a", " b ", "&amp;", "<b>", "</b>", "<svg>", "</svg>", "<!--", "-->", "<script>", "</script>", '<a t="', '">', "'", ">", "</head>", "<p"]
    r = random.Random(1)
    pages = ["".join(r.choice(parts) for _ in range(r.randint(1, 16))) for _ in range(3000)]
    assert [early(h) for h in pages] == [whole(h) for h in pages] and len({whole(h) for h in pages}) > 20

    read, attributes = [], dom.attributes
    monkeypatch.setattr(dom, "attributes", lambda rest: read.append(rest) or attributes(rest))
    assert early("<head><title></title><title x=1>a</title></head>" + "<p id=x>b</p>" * 100) == "a" and len(read) == 3


@pytest.mark.parametrize("name", ["digest_parse_links", "digest_parse_sections", "digest_merge", "page_title"])
def test_links_of_odd_titles_and_addresses(spark, tmp_path, name):
    """Markup and ends of line in a title, brackets in an address: no link is lost, none is made up."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    titles = ["a\nb", "a\r\n\n b", "x\n\n", "<b>x</b>", "a<b", "a <i", "1 > 0 <", "a](b", "a]\nb", "a\n[b", "[c\nd", "(t)", "t", "]"]
    urls = ["a", "a(b)", "a)", "(a)/pricing", "a]", "a](b", "blog/f(x)(y)"]
    rows = [(t.strip(), f"https://s{i % 2}.org/{u}") for i, t in enumerate(titles) for u in urls]
    n = range(len(rows))
    pq.write_table(pa.table({"page_id": list(n), "url": [u for _, u in rows], "html": [PAGE.format(t, "text") for t, _ in rows]}), f"{tmp_path}/pages.parquet")
    assert same_as_sql(spark, tmp_path, name)


def test_a_link_goes_on_up_to_its_bracket():
    from siteloom.operators.digest import read_lines

    doc = "# T\n\n## S\n\n### Links\n\n- [a\n\n b](u): d\n- [broken\n- [c](v)\n- [open\n---\n\n## R\n\n### Links\n\n- [x\n## y](z)"
    links = [s for _, _, s, kind, _ in read_lines(doc) if kind == "link"]
    assert links == ["- [a\n\n b](u): d", "- [c](v)"]
    assert [kind for *_, kind, _ in read_lines(doc)][6:13] == ["link", "more", "more", "swallowed", "link", "swallowed", "rule"]


@pytest.mark.parametrize("name", ["page_content_hash", "page_main_text"])
def test_text_around_noise_and_blanks(spark, tmp_path, name):
    """Noise parts no word and makes no box a content; only white space that HTML folds is folded."""
    noise = ["<script>a</script>", "<style>p{}</style>", "<noscript>n</noscript>", "<svg><path/></svg>", "<iframe>i</iframe>", "<video>v<track></video>", "<embed src=a>", "<!-- c -->"]
    bodies = [f"<p>x{n}y {n}z</p>" for n in noise] + [f"<main>{n}</main><article>x</article>" for n in ["", " ", "<br>", *noise]] + [f"<main>{n}</main><article>{n}</article>" for n in noise]
    blanks = ["&nbsp;", "\xa0", "\u2003", "\u202f", "\u3000", "\u2028", "\x85", "\u200b", "\x0b", "\x1c", "\t", "\x0c", "\r\n", "&nbsp; &nbsp;"]
    bodies += [f"<p>a{b}b</p>{b}<p>{b}c</p>{b}" for b in blanks] + [f"{b}a{b}" for b in blanks] + blanks
    assert same_as_sql(spark, odd_pages(tmp_path, [f"<title>t</title><body>{b}</body>" for b in bodies]), name)


def test_a_long_address_of_brackets_is_read_whole(spark):
    from siteloom.operators import digest

    doc = "# T\n\n## S\n\n### Links\n\n- [t](http://x/" + "]" * 50_000 + "): d"
    found = digest.parsed_links(digest.parse_lines(spark.createDataFrame([("a", doc)], "site string, content string"))).first()
    assert (len(found.url), found.title, found.description) == (50_009, "t", "d")
