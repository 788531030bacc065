"""Which URLs list their key in the URL filter query."""

from siteloom.llm.queries import op10_url_filters


def test_tracking_parameter_at_any_place(spark, tmp_path):
    urls = ["http://h.com/a?x=1&utm_source=n", "http://h.com/b?utm_source=n", "http://h.com/c?x=1#?utm_source=n", "http://h.com/d?my_utm_source=n", "http://h.com/e&utm_source=n"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.verdict for r in op10_url_filters(spark, str(tmp_path)).collect()} == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "allow"}
