"""Providers that fail, are busy or die, and sites too large for one question."""

import json
import os
import sys
import time
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from siteloom.operators import curate, providers
from siteloom.operators.replies import Busy, Manners, ReplyStore, ask_stored, questions

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see this module


def batches(spark, n=40):
    return spark.range(n).select(F.lit("s").alias("site"), F.col("id").alias("batch"), F.col("id").alias("page_id"), F.concat(F.lit("http://s/"), "id").alias("url"))


def noted(folder, rows):
    """Leave a mark of each call, as a paid service would."""
    Path(folder, f"{int(rows['batch'].iloc[0])}-{time.time_ns()}").touch()


def calls(folder):
    found = [int(f.name.split("-")[0]) for f in Path(folder).iterdir() if "-" in f.name]
    return {b: found.count(b) for b in set(found)}


def test_a_run_that_dies_half_way_asks_only_for_the_rest(spark, tmp_path):
    folder, fatal = tmp_path / "calls", tmp_path / "fatal"
    folder.mkdir()
    fatal.touch()

    def provider(rows, folder=str(folder), fatal=str(fatal)):
        noted(folder, rows)
        if rows["batch"].iloc[0] == 33 and os.path.exists(fatal):
            os._exit(1)  # the worker is gone, as with a lost executor
        return json.dumps({"relevant_urls": list(rows["url"])})

    store, asked = ReplyStore(spark, f"{tmp_path}/store"), batches(spark)
    manners = Manners(tasks=2, flush=1)
    with pytest.raises(Exception, match="crash|exit|EOF"):
        providers.ask(asked, provider, store=store, name="p", manners=manners)
    held = {m for m in calls(folder)}
    assert 0 < len(held) < 40 and 33 in held
    fatal.unlink()
    done = providers.ask(asked, provider, store=store, name="p", manners=manners).collect()
    assert len(done) == 40 and all(json.loads(r.reply)["relevant_urls"] == [f"http://s/{r.batch}"] for r in done)
    assert calls(folder) == {b: 2 if b == 33 else 1 for b in range(40)}
    # Nothing is asked a third time, by another name all is; files in one place say the same.
    store.compact()
    assert providers.ask(asked, provider, store=store, name="p").where("reply IS NOT NULL").count() == 40
    assert sum(calls(folder).values()) == 41
    providers.ask(asked.where("batch < 3"), provider, store=store, name="other")
    assert sum(calls(folder).values()) == 44


def test_failures_are_kept_and_asked_again(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()

    def provider(rows, folder=str(folder)):
        noted(folder, rows)
        b, n = int(rows["batch"].iloc[0]), len([f for f in os.listdir(folder) if f.startswith(f"{int(rows['batch'].iloc[0])}-")])
        if b == 1 and n < 3:
            raise Busy(0.01)
        if b == 2 and n < 5:
            raise ValueError("no such model")
        return "{}"

    store, asked = ReplyStore(spark, f"{tmp_path}/store"), batches(spark, 4)
    manners = Manners(tasks=2, wait_s=0.01)
    ask = lambda: {r.batch: (r.reply, r.error) for r in providers.ask(asked, provider, store=store, name="p", manners=manners).collect()}
    assert ask() == {0: ("{}", None), 1: ("{}", None), 2: (None, "ValueError: no such model"), 3: ("{}", None)}
    assert calls(folder) == {0: 1, 1: 3, 2: 3, 3: 1}
    assert ask()[2] == ("{}", None) and calls(folder) == {0: 1, 1: 3, 2: 5, 3: 1}
    tries = {(r.error is None, r.tries) for r in store.read().collect()}
    assert tries == {(True, 1), (True, 3), (False, 3), (True, 2)}
    kept = providers.ask(asked, lambda rows: 1 / 0).collect()
    assert all(r.reply is None and r.error.startswith("ZeroDivisionError") for r in kept)


def test_rate_and_equal_questions(spark, tmp_path):
    store = ReplyStore(spark, f"{tmp_path}/store")
    twice = batches(spark, 6).drop("batch", "page_id", "url").withColumn("x", F.lit(None).cast("string")).withColumn("batch", F.monotonically_increasing_id() * 0)
    asked = questions(twice, ("site", "batch"), "p")
    began = time.time()
    assert ask_stored(asked, lambda rows: str(len(rows)), "p", store, Manners(tasks=1, per_minute=60)).first().reply == "6"
    assert time.time() - began >= 1
    assert questions(twice, ("site", "batch"), "q").first().mark != asked.first().mark
    assert ask_stored(asked.limit(0), lambda rows: "", "p", store).count() == 0


def site(spark, n, site="big", sections=7):
    return spark.range(n).select(F.lit(site).alias("site"), F.format_string(f"http://{site}/part%d/p%d", F.col("id") % sections, "id").alias("url"), F.lit("t").alias("title"))


def test_no_question_holds_a_site(spark, tmp_path):
    seen = tmp_path / "sizes"
    seen.mkdir()

    def counted(rows, seen=str(seen)):
        Path(seen, f"{len(rows)}-{time.time_ns()}").touch()
        return providers.rule_curation(rows)

    pages = site(spark, 20_000).union(site(spark, 3, "small"))
    found = providers.curate_sites(pages, counted, at_once=100)
    got = sorted(tuple(r) for r in found.sections.collect())
    assert got == sorted([("big", f"part{i}", f"{n} pages under part{i}.", n) for i in range(7) for n in [len(range(i, 20_000, 7))]] + [("small", f"part{i}", f"1 pages under part{i}.", 1) for i in range(3)])
    assert found.pages.count() == 20_003 and {r.site: r.answer.overview for r in found.headers.collect()} == {"big": "20000 pages.", "small": "3 pages."}
    sizes = [int(f.name.split("-")[0]) for f in seen.iterdir()]
    assert max(sizes) < 200 and len(sizes) >= 200


def test_names_are_merged_over_rounds(spark):
    """Sixty names that are five without case, ten a question; a failed batch and pages that no reply lists."""

    def provider(rows):
        if (rows["url"] == "http://big/part0/p0").any():
            raise OSError("down")
        rows = rows[~rows["url"].str.endswith("9")]
        named = rows.assign(section=[("NAME" if int(u.rsplit("p", 1)[1]) % 2 else "name") + f"{int(u.rsplit('p', 1)[1]) % 30 // 6}" for u in rows["url"]])
        sections = [{"name": s, "description": "", "pages": [{"url": u} for u in part["url"]] + [{"url": "http://invented/"}]} for s, part in named.groupby("section")]
        return json.dumps({"sections": sections})

    found = providers.curate_sites(site(spark, 600), provider, at_once=20, names=4)
    pages = {r.url: r.section for r in found.pages.collect()}
    assert len(pages) == 600 and set(pages.values()) == {f"NAME{i}" for i in range(5)} | {"Other"}
    assert all(pages[u] == "Other" for u in pages if u.endswith("9")) and pages["http://big/part0/p0"] == "Other"
    assert sum(r.n for r in found.sections.collect()) == 600
    broken = providers.curate_sites(site(spark, 30), merger=lambda rows: "not JSON")
    assert {r.section for r in broken.sections.collect()} == {f"part{i}" for i in range(7)}
    assert providers.curate_sites(site(spark, 0)).pages.count() == 0


def test_relevance_through_the_store(spark, tmp_path):
    rows = spark.createDataFrame([("s", 0, 1, "http://s/about"), ("s", 0, 2, "http://s/tag/x"), ("s", 1, 3, "http://s/login")], "site string, batch long, page_id long, url string")
    store = ReplyStore(spark, f"{tmp_path}/store")
    for _ in range(2):
        assert [r.page_id for r in curate.kept_by_replies(rows, curate.replies(rows, store=store)).collect()] == [1]
    assert store.read().count() == 2


def test_every_page_of_an_address_has_its_section(spark):
    """Three rows of one address: asked about once, counted and returned three times."""
    asked = spark.createDataFrame([("s", "http://s/a/1", "b"), ("s", "http://s/a/1", "a"), ("s", "http://s/a/1", "b"), ("s", "http://s/a/2", "c")], "site string, url string, title string")
    found = providers.curate_sites(asked)
    assert [tuple(r) for r in found.sections.collect()] == [("s", "a", "4 pages under a.", 4)]
    assert sorted((r.url, r.title) for r in found.pages.collect()) == [("http://s/a/1", "a"), ("http://s/a/1", "b"), ("http://s/a/1", "b"), ("http://s/a/2", "c")]
    assert [r.answer.overview for r in found.headers.collect()] == ["2 pages."]
