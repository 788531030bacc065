"""Crawls in rounds: order, budgets, failures, redirects, stops."""

import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from siteloom.functions.url import SKIP_DISCOVERY
from siteloom.operators import links
from siteloom.sources import site_crawl
from siteloom.sources.crawl_rounds import Crawl

QUIET = {"delay": "0", "wait": "0.01"}


def page(*to):
    return "".join(f'<a href="{t}">x</a>' for t in to)


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("saved"))
    rows = [(f"http://h/{i}", page(f"/{2 * i + 1}", f"/{2 * i + 2}?a#b", "/none", "/x.pdf", "http://o/0")) for i in range(40)]
    rows += [("http://o/0", page("1", "/long" + "g" * 300, "//o/0;p=1")), ("http://o/1", ""), ("http://o/long" + "g" * 300, None), (None, "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    assert site_crawl.save_pages(df, folder) == 43
    return df, folder


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_equals_the_crawl_of_a_table(spark, tmp_path, saved, most):
    df, folder = saved
    seeds = spark.createDataFrame([("http://h/0",), ("http://o/0",), ("http://gone/",), ("no address",)], "url string")
    want = {tuple(r) for r in links.crawl(df.where("url IS NOT NULL"), seeds, most).collect()}
    at = f"{tmp_path}/crawl"
    first = Crawl(spark, at, QUIET | {"folder": folder}, most, tasks=3)
    assert {r.depth for r in first.run(seeds, rounds=1).collect()} == {0}
    found = Crawl(spark, at, QUIET | {"folder": folder}, most, tasks=3).run(seeds).collect()
    assert {(r.site, r.node, r.depth) for r in found if r.ok} == want
    assert Crawl(spark, at, QUIET | {"folder": folder}, most).run(seeds).count() == len(found)
    assert all(r.status == 404 and r.html is None for r in found if not r.ok) and len({r.node for r in found}) == len(found)


def test_a_round_that_is_not_whole_is_asked_again(spark, tmp_path, saved):
    _, folder = saved
    seeds = spark.createDataFrame([("http://h/0",)], "url string")
    crawl = Crawl(spark, str(tmp_path), QUIET | {"folder": folder}, 20)
    crawl.run(seeds, rounds=2)
    whole = crawl.run(seeds)
    want = sorted(tuple(r) for r in whole.collect())
    for name in ("pages/round=3", "level/round=3"):  # killed while the table was written
        (tmp_path / name / "_SUCCESS").unlink()
    assert crawl.pages().agg({"depth": "max"}).first()[0] == 2
    assert sorted(tuple(r) for r in crawl.run(seeds).collect()) == want


def test_servers_that_are_busy_redirect_or_need_scripts(spark, tmp_path):
    asked = Counter()
    lock = threading.Lock()

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            with lock:
                asked[self.path] += 1
                n = asked[self.path]
            if self.path == "/busy" and n < 3:
                self.send_response(503)
                self.end_headers()
                return
            if self.path in ("/moved", "/away"):
                self.send_response(302)
                self.send_header("Location", "/sub/new" if self.path == "/moved" else f"http://localhost:{self.server.server_port}/sub/new")
                self.end_headers()
                return
            found = {"/": page("/moved", "/away", "/busy", "/gone"), "/sub/new": page("next"), "/sub/next": "n", "/busy": "b"}.get(self.path)
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", "text/html; charset=none-such")
            self.end_headers()
            self.wfile.write((found or "no").encode())

        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"this is no JSON" if asked["/service"] else b'{"html": "rendered", "status": 200}')

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    seeds = spark.createDataFrame([(f"{at}/",)], "url string")
    try:
        found = {r.node.removeprefix(at): (r.ok, r.status, r.depth) for r in Crawl(spark, f"{tmp_path}/a", QUIET | {"backend": "http"}, 5).run(seeds).collect()}
        assert found == {"/": (True, 200, 0), "/away": (False, 200, 1), "/busy": (True, 200, 1), "/gone": (False, 404, 1), "/moved": (True, 200, 1), "/sub/next": (True, 200, 2)}
        assert asked["/busy"] == 3 and asked["/gone"] == 1
        options = QUIET | {"backend": "http", "render": "service", "endpoint": at}
        assert [r.html for r in Crawl(spark, f"{tmp_path}/b", options, 1).run(seeds).collect()] == ["rendered"]
        asked["/service"] = 1
        assert site_crawl.from_service("http://x/", {"endpoint": at}) == (None, 502)
    finally:
        server.shutdown()
        server.server_close()
    assert site_crawl.from_site("file:///etc/hostname", {}) == (None, 0)


def test_failures_use_no_budget(tmp_path):
    (tmp_path / "http%3A%2F%2Fh%2F").write_text(page("/0", "/1", "/a"))
    (tmp_path / "http%3A%2F%2Fh%2Fa").write_text("a")
    got = list(site_crawl.crawled("http://h/", site_crawl.from_folder, {"folder": str(tmp_path)}, 2))
    assert [(u, s) for u, _, s, _ in got] == [("http://h/", 200), ("http://h/0", 404), ("http://h/1", 404), ("http://h/a", 200)]
    assert site_crawl.page_key("http://H.org/A/;x=1?q#f") == "http://h.org/a" and ".ico" in SKIP_DISCOVERY
