"""Blocks of the relevance prompt for pages with little content."""

from pyspark.sql import functions as F

from siteloom.operators import curate


def test_preview_and_sections(spark):
    rows = [("short", "p" * 300, list("abcdef")), ("", None, ["h"]), ("", "", []), ("short", None, None), ("c" * 51, "p", ["h"])]
    df = spark.createDataFrame([(i, "u", "t", *r) for i, r in enumerate(rows)], "i int, url string, title string, text string, para string, h2s array<string>")
    got = df.orderBy("i").select(curate.page_entry(F.col("i"), "url", "title", "text", "para", "h2s")).collect()
    bodies = [f"   Preview: {'p' * 200}...\n   Sections: a, b, c, d, e\n", "   Sections: h\n", "   Content: [EMPTY PAGE - NO CONTENT]\n", "", f"   Content:\n{'c' * 51}\n"]
    assert [r[0] for r in got] == [f"{i}. URL: u\n   Title: t\n{b}" for i, b in enumerate(bodies)]
