"""``spark.read.format("site_crawl")``: pages of stored or fetched sites.

The reader splits its addresses over tasks. With ``follow`` each address is the start of a
site, which one task crawls by its links: pages of the same host, in order of depth, each
normal form once, up to ``max_pages``. Fetching is a strategy by name: ``folder`` reads
saved pages, ``http`` fetches from the site, ``service`` asks a hosted crawler.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterator
from http.client import HTTPException
from typing import NamedTuple
from urllib.error import HTTPError
from urllib.parse import quote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siteloom.conf import CONF

SCHEMA = "url string, html string, status int"


class Fetched(NamedTuple):
    """What came of a request: the page or null, its status (0 without an answer), and the address that answered."""

    html: str | None
    status: int
    url: str


def _folder(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder.removeprefix("file:")))


def _saved_as(address: str) -> str:
    """The name of a saved page: its percent-encoded address, or the hash of one that is too long for a name."""
    name = quote(address, safe="")
    return name if len(name) <= 240 else hashlib.sha256(address.encode()).hexdigest()


def save_pages(pages: DataFrame, folder: str) -> int:
    """Save ``pages (url, html)`` where :func:`from_folder` finds them; how many."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, root = _folder(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for address, html in zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/{_saved_as(address)}") as out:
                    out.write((html or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return pages.select("url", "html").where("url IS NOT NULL").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0


def from_folder(address: str, options: dict) -> tuple[str | None, int]:
    """A page saved under its percent-encoded address in ``options['folder']``, a path or URI of any store."""
    from pyarrow import fs

    store, root = _folder(options["folder"])
    name = f"{root}/{_saved_as(address)}"
    if store.get_file_info(name).type != fs.FileType.File:
        return None, 404
    return store.open_input_stream(name).read().decode(errors="replace"), 200


def _asked(request, options: dict) -> tuple[bytes | None, int, str, str]:
    """Body, status, character set and final address."""
    from urllib.request import urlopen

    address = request.full_url
    if urlsplit(address).scheme not in ("http", "https"):
        return None, 0, "utf-8", address
    try:
        with urlopen(request, timeout=float(options.get("timeout", 15))) as answer:
            return answer.read(), answer.status, answer.headers.get_content_charset() or "utf-8", answer.url
    except HTTPError as e:
        return e.read(), e.code, "utf-8", e.url or address
    except (OSError, HTTPException):  # no connection, no answer in time, or none that is HTTP
        return None, 0, "utf-8", address


def _decoded(body: bytes | None, charset: str) -> str | None:
    try:
        return None if body is None else body.decode(charset, "replace")
    except LookupError:  # a character set that does not exist
        return body.decode("utf-8", "replace")


def site_page(address: str, options: dict) -> Fetched:
    """The page itself; status 0 if no answer came within ``options['timeout']`` seconds."""
    from urllib.request import Request

    body, status, charset, final = _asked(Request(address, headers={"User-Agent": options.get("agent", "siteloom")}), options)
    return Fetched(_decoded(body, charset), status, final)


def from_site(address: str, options: dict) -> tuple[str | None, int]:
    return site_page(address, options)[:2]


def from_service(address: str, options: dict) -> tuple[str | None, int]:
    """From a hosted crawler at ``options['endpoint']``: a POST of ``{"url": ...}`` answered by ``{"html": ..., "status": ...}``; 502 for any other answer."""
    import json
    from urllib.request import Request

    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {options['token']}"} if "token" in options else {})
    body, status, *_ = _asked(Request(options["endpoint"], json.dumps({"url": address}).encode(), headers), options)
    if status != 200:
        return None, status
    try:
        answer = json.loads(body)
        return answer.get("html"), int(answer.get("status", 200))
    except (ValueError, AttributeError, TypeError):
        return None, 502


BACKENDS = {"folder": from_folder, "http": site_page, "service": from_service}


def fetched(fetch, address: str, options: dict) -> Fetched:
    """A backend's answer; one that does not say which address answered means the one it was asked."""
    html, status, *final = fetch(address, options)
    return Fetched(html, status, final[0] if final else address)


def page_key(address: str) -> str:
    """The normal form of ``functions.url.page_key``."""
    at = urlsplit(address)
    path = at.path.split(";", 1)[0].rstrip("/") or "/"
    return f"{at.scheme}://{at.netloc}{path}".lower()


def crawled(start: str, fetch, options: dict, most: int) -> Iterator[tuple]:
    """``(url, html, status, depth)`` of the pages of a site that links lead to from its start; failures do not count as pages."""
    from siteloom.functions.dom import link_targets
    from siteloom.functions.url import SKIP_CRAWL

    home = urlsplit(start).netloc
    waiting, known, found = deque([(start, 0)]), {page_key(start)}, 0
    while waiting and found < most:
        address, depth = waiting.popleft()
        html, status, final = fetched(fetch, address, options)
        found += html is not None and status < 400
        yield address, html, status, depth
        for href, target in link_targets(final, html or ""):
            if not href or target is None or href.startswith(("javascript:", "mailto:", "tel:", "#")):
                continue
            at = urlsplit(target)
            if at.netloc == home and not any(x in at.path.lower() for x in SKIP_CRAWL) and (key := page_key(target)) not in known:
                known.add(key)
                waiting.append((key, depth + 1))


def _follows(options: dict) -> bool:
    return options.get("follow", "false").lower() == "true"


class SiteCrawl(DataSource):
    """A row a page; with ``follow`` also its depth. Options: ``urls`` (one a line), ``backend``, ``follow``, ``max_pages``, ``per_task`` and what the backend takes."""

    @classmethod
    def name(cls) -> str:
        return "site_crawl"

    def schema(self) -> str:
        return SCHEMA + ", depth int" * _follows(self.options)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.follow = _follows(options)
        if options.get("backend", "folder") not in BACKENDS:
            raise ValueError(f"backend must be one of {sorted(BACKENDS)}")

    def partitions(self) -> list[InputPartition]:
        urls = self.options.get("urls", "").split()
        n = int(self.options.get("per_task", 1 if self.follow else 100))
        return [InputPartition(tuple(urls[i : i + n])) for i in range(0, len(urls), n)] or [InputPartition(())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch = BACKENDS[self.options.get("backend", "folder")]
        for url in partition.value:
            if self.follow:
                yield from crawled(url, fetch, self.options, int(self.options.get("max_pages", CONF.max_pages)))
            else:
                yield url, *fetched(fetch, url, self.options)[:2]


def register(spark) -> None:
    spark.dataSource.register(SiteCrawl)
