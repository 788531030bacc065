"""Every call through SQL."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siteloom import surface
from siteloom.functions.url import format_error

AT = datetime(2024, 1, 30, 10)


@pytest.fixture(scope="module")
def sql(spark):
    rows = {
        "sites": ([(1, "Blog o'Neil", "http://a.org/", "ready"), (2, "Shop", "https://b.org", "crawling")], "site long, name string, url string, status string"),
        "digests": ([(1, 1, "old", AT), (1, 2, "new", AT), (2, 1, "only", AT)], "site long, version long, content string, at timestamp"),
        "job_events": ([("j", AT, "start", None), ("j", datetime(2024, 1, 30, 11), "complete", 4)], "job string, ts timestamp, kind string, value int"),
        "progress_events": ([(1, AT, 1), (2, datetime(2024, 1, 30, 11, 30), 2)], "site long, ts timestamp, id long"),
        "queue": ([("full", 1, AT), ("full", 2, datetime(2024, 2, 1)), ("light", 2, AT), ("cooldown", 2, datetime(2024, 2, 1))], "queue string, site long, run_at timestamp"),
    }
    surface.register(spark, {k: spark.createDataFrame(*v) for k, v in rows.items()}, "2024-01-30 12:00:00")
    return lambda text: sorted(map(tuple, spark.sql(text).collect()), key=str)


def test_views(sql):
    assert sql("SELECT site, n_versions FROM site_list WHERE status = 'ready'") == [(1, 2)]
    assert sql("SELECT job, status, pages FROM site_jobs") == [("j", "completed", 4)]
    assert sql("SELECT site FROM site_progress") == [(2,)]
    assert sql("SELECT site, content FROM digest_current") == [(1, "new"), (2, "only")]
    assert sql("SELECT * EXCEPT (at) FROM digest_list") == [(1, 1), (1, 2), (2, 1)]
    assert sql("SELECT queue, site, place FROM schedule_due") == [("full", 1, 1), ("light", 2, 1)]
    assert sql("SELECT * FROM schedule_totals") == [("cooldown", 1, 1), ("full", 1, 2), ("light", 1, 1)]


def test_functions(sql):
    assert sql("SELECT site FROM site_by_text('O\\'NEIL')") == [(1,)] and sql("SELECT site FROM site_by_text('B.ORG')") == [(2,)]
    assert sql("SELECT version FROM digests_of(1)") == [(1,), (2,)] and sql("SELECT content FROM digest_of(1, 1)") == [("old",)] and sql("SELECT * FROM digest_of(3, 1)") == []
    assert sql("SELECT * FROM recrawl_verdict(1)") == [(1, True)] and sql("SELECT accepted FROM recrawl_verdict(2)") == [(False,)] and sql("SELECT * FROM recrawl_verdict(9)") == []
    assert sql("SELECT * FROM register_verdict('http://a.org///')") == [("http://a.org", "exists")]
    assert sql("SELECT verdict FROM register_verdict('http://new.org')") == [("added",)] and sql("SELECT verdict FROM register_verdict('ftp://x.org')") == [("URL must use http:// or https://",)]
    assert sql("SELECT kind FROM (SELECT '# T\n\n> tag' AS c), LATERAL digest_lines(c)") == [("lost",), ("tagline",), ("title",)]


def test_address_errors_are_those_of_the_library(spark, sql):
    urls = ["http://a.org", "HTTPS://A.org:80/x", "ftp://x.org", "http://", "http://-a.org", "localhost", "http://localhost:1/", "http://a", "", None, "http://a_b.org", "http://a.org?x'y\\"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    df.createOrReplaceTempView("some_addresses")
    assert sql("SELECT u, address_error(u) FROM some_addresses") == sorted(map(tuple, df.select("u", format_error("u")).collect()), key=str)


def test_tables_that_lack_columns(spark):
    with pytest.raises(ValueError, match="digests lacks content"):
        surface.register(spark, {"digests": spark.range(1).select(F.lit(1).alias("site"), F.lit(1).alias("version"), F.lit(1).alias("at"))}, "2024-01-01 00:00:00")
    surface.register(spark, {}, "2024-01-01 00:00:00")
