"""Wrappers and main text on templates, broken markup and odd rows."""

import json

from siteloom.llm import wrappers as w


def keys(node):
    return [(k.key + "?" * k.opt + "+" * k.rep, keys(k)) if k.kids else k.key + "?" * k.opt + "+" * k.rep for k in node.kids]


def test_repeats_options_and_slots():
    a = w.page_wrapper("<ul><li>a<li>b<li>c</ul><p>one</p><p>two</p>")
    assert keys(a) == [("ul", [("li+", ["#"])]), ("p+", ["#"])]
    b = w.page_wrapper("<ul><li>x</ul><h2>t</h2><p>one</p>")
    both = w.align(a.kids, b.kids)
    assert [(k.key, k.opt, k.rep) for k in both] == [("ul", False, False), ("h2", True, False), ("p", False, True)]
    assert both[1].kids[0].text == "t" and both[0].kids[0].kids[0].text is None
    squares = w.page_wrapper("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")
    assert keys(squares) == [("dl", [("dt+", ["#"]), ("dd+", ["#"])])]
    again = w.Node.load(json.loads(json.dumps(a.dump())))
    assert keys(again) == keys(a)


def text(page):
    return w.extract(page, w.content_of(w.page_wrapper(page)))


def test_article_without_what_serves_the_site():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
    <div class="cookie-notice">We use cookies</div><aside class=sidebar>Side</aside>
    <article><header class="entry-header"><h1>Title &amp; more</h1></header><p>First   <b>bold</b>\n text&nbsp;here.<p>Second <a href=x>link</a>.<div class="ad">Buy</div>
    <form><input><label>Mail</label></form><script>var t="</p>"</script><!-- <p>no</p> --><ul><li>i<li>j</ul><div class="share-buttons">Share</div>
    <section class="comments"><p>Nice</p></section></article><div id="comments"><article class="comment">Reader</article></div><footer>&copy;</footer></body></html>"""
    assert text(page) == "Title & more\nFirst bold text here.\nSecond link.\ni\nj"


def test_pages_without_an_article():
    page = "<body><div class=menu><a href=a>One</a><a href=b>Two</a></div><div class=wrap><div id=story><p>" + "word " * 80 + "</p><p>end</p></div></div><div>tiny</div></body>"
    assert text(page) == ("word " * 80).strip() + "\nend"
    assert text("") == "" and text("just text") == "just text" and text("<p>a<p>b") == "a\nb"


def test_broken_markup():
    assert text("<article><h1>T</h1><p><b>open<br><p>next</b></i></p>tail") == "T\nopen\nnext\ntail"
    assert text("<article><p>cut &am") == "cut &am"
    assert text("<article><p>cut <a hre") == "cut"
    assert text("<article><p>a < b > c</p><!-- open") == "a < b > c"
    assert text('<article><p title="a>b">x</p></article><p>out') == "x"
    assert text("<article>&lt;p&gt; &#65;&#x42; &amp;lt;</article>") == "<p> AB &lt;"


def test_pages_by_host(spark):
    page = lambda i: f"<body><nav><a>n{i}</a></nav><main><p>text {i}</p>{'<p>more</p>' * (i % 3)}</main></body>"
    rows = [(i, f"http://h{i % 3}/x", page(i)) for i in range(30)] + [(30, None, page(30)), (31, "odd", None), (31, "odd", None), (32, "http://h0/", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {}
    for r in w.main_text(df).collect():
        got.setdefault((r.id, r.url), []).append(r.text)
    for i, u, h in rows:
        assert set(got[(i, u)]) == {"\n".join([f"text {i}"] + ["more"] * (i % 3)) if h else ""}
    assert sum(map(len, got.values())) == len(rows)
    assert w.main_text(df.limit(0)).count() == 0


def host_texts(pages):
    whole = w.page_wrapper(pages[0])
    for p in pages[1:]:
        whole = w.merged(whole, w.page_wrapper(p))
    plan = w.Plan.load(w.content_of(w.Node.load(json.loads(json.dumps(whole.dump())))).dump())
    return [w.extract(p, plan) for p in pages]


def words(i, n):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_strings_of_the_template_vanish_and_slots_stay():
    """A paragraph that every page of a host has goes; alone, a page shows no difference between the two."""
    fixed = "Read more of our stories every day."
    pages = [f"<body><div class=top>Our site</div><div class=x><h1>T{i}</h1><p>{fixed}</p><p>{words(i, 40)}</p>{'<p>more ' + words(i + 50, 9) + '</p>' * (i % 3)}</div></body>" for i in range(20)]
    got = host_texts(pages)
    for i, (page, text_) in enumerate(zip(pages, got, strict=True)):
        assert fixed not in text_ and f"T{i}\n{words(i, 40)}" in text_
        assert fixed in text(page)  # without the host's other pages nothing tells it from content
    few = host_texts(pages[:4])
    assert all(fixed in t for t in few)


def test_content_is_where_pages_differ():
    """Without article or main the element whose slots hold most text wins over one with more fixed text."""
    pages = [f"<body><div class=a><p>{words(0, 200)}</p></div><div class=b><p>{words(i, 30)}</p><p>{words(i + 100, 20)}</p></div></body>" for i in range(1, 9)]
    assert host_texts(pages) == [f"{words(i, 30)}\n{words(i + 100, 20)}" for i in range(1, 9)]
    assert text(pages[0]) == words(0, 200)


def test_copies_of_a_page_keep_their_text():
    copy = f"<body><article><h1>T</h1><p>{words(1, 30)}</p><p>{words(2, 30)}</p></article></body>"
    near = [copy.replace("w1x3 ", f"e{i} ") for i in range(10)]
    other = f"<body><article><h1>O</h1><p>{words(3, 30)}</p></article></body>"
    assert host_texts([copy] * 20 + [other]) == [text(copy)] * 20 + [text(other)]
    assert host_texts([*near, other]) == [text(p) for p in near] + [text(other)]


def test_names_that_only_contain_site_words():
    page = """<article><h1>T</h1><div class="related-work"><p>a</p></div><p class="alert">b</p><section id="search-methods">c</section><div class="side-by-side">d</div><div class="sharePrice">e</div>
    <div class="related-posts">no</div><div class="relatedPosts">no</div><div id="comments">no</div><div class="cookie-notice-box">no</div><ul class="share">f</ul></article>"""
    assert text(page) == "T\na\nb\nc\nd\ne\nf"


def test_several_content_elements():
    page = "<body><div><article class=one><p>" + words(1, 20) + "</p></article><article class=two><p>" + words(2, 20) + "</p></article></div><footer>no</footer></body>"
    assert text(page) == f"{words(1, 20)}\n{words(2, 20)}"


def test_repeated_groups_match_runs():
    items = w.page_wrapper("<h2>a</h2><p>b</p><dl>c</dl><dt>x</dt><dd>y</dd><dt>x</dt><dd>y</dd><hr><p>z</p>").kids
    page = w.page_tree("<h2>a</h2><p>b</p><p>b</p><dl>c</dl><dt>x<dd>y<dt>x<dd>y<dt>x<dd>y</dd><p>z</p>").kids
    got = [m and m.key for m in w._places(page, items)]
    assert got.count(None) == 1 and got[-1] == "p" and got[4:10] == ["dt", "dd"] * 3


def test_deep_and_long_pages(spark):
    deep = "<div>" * 10_000 + "<p>deep</p>" + "</div>" * 10_000
    assert text(f"<body><article>{deep}</article></body>") == "deep" and text(deep) == "deep"
    assert host_texts([deep, deep.replace("deep", "other"), "<p>flat</p>"]) == ["deep", "other", "flat"]
    long = "<article>" + "".join(f"<{'p' if i % 3 else 'h2'}>{i}</{'p' if i % 3 else 'h2'}>" for i in range(20_000)) + "</article>"
    assert text(long) == "\n".join(map(str, range(20_000)))
    df = spark.createDataFrame([(0, "http://h/", deep), (1, "http://h/", long)], "page_id long, url string, html string")
    assert {r.id: len(r.text) for r in w.main_text(df).collect()} == {0: 4, 1: len(text(long))}


def test_texts_do_not_depend_on_the_order_or_partitions_of_pages(spark):
    """Strings that some pages share, options and repeats, folded forwards, backwards, mixed, in one task and in many."""
    import random

    rng = random.Random(2)
    rows = []
    for i in range(60):
        shared = "<p>Join our readers on the spring list today.</p>" if i >= 26 else ""
        odd = rng.choice(["", "<h2>Part</h2><p>x</p>", "<ul><li>a<li>b</ul>", "<div class=box><p>in a box</p></div>"])
        rows.append((i, f"http://h{i % 2}.org/{i}", f"<body><div class=m>menu</div><div class=x><h1>T{i}</h1>{shared}<p>{words(i, 30)}</p>{odd}{'<p>' + words(i + 99, 8) + '</p>' * (i % 4)}</div></body>"))
    got = []
    for n, order in enumerate((rows, rows[::-1], rng.sample(rows, len(rows)), rng.sample(rows, len(rows)))):
        df = spark.createDataFrame(order, "page_id long, url string, html string").repartition((1, 7, 3, 20)[n])
        got.append({r.id: r.text for r in w.main_text(df).collect()})
    assert got[0] == got[1] == got[2] == got[3] and all(f"T{i}" in t and words(i, 30) in t for i, t in got[0].items())
    assert sum("spring list" in t for t in got[0].values()) < 5  # of 34, half of the pages of each host
