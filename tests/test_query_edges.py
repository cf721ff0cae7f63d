"""Queries against their SQL on rows that the test tables don't have."""

import pytest

from causeway.plans import all_queries
from tests.compare import connect, expected, rows_of


def same(spark, folder, name):
    return rows_of(all_queries.QUERIES[name](spark, str(folder))) == expected(connect(str(folder)), all_queries.ORACLES[name])


@pytest.mark.parametrize("n", [50, 100, 1_000_000, 1_000_001])
def test_row_count_at_its_bounds(spark, tmp_path, n):
    spark.range(n).withColumnRenamed("id", "event_id").coalesce(1).write.parquet(f"{tmp_path}/parts")
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "events.parquet")
    assert same(spark, tmp_path, "Q01_row_count")


def test_references_cut_short_stay(spark, tmp_path):
    html = ["<title>a&amp;&amp</title><p>b &amp;lt; &copy; &lt</p>", "<p>x &amp", "<p>&ampc; & d&nbsp;</p>", "", None]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id long, html string")
    df.coalesce(1).write.parquet(f"{tmp_path}/parts")
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    assert same(spark, tmp_path, "X05_html_parser")


def test_long_pages_are_read_whole(spark, tmp_path):
    html = ["<p>" + "word " * 20_000 + "last</p>", "<p>word</p>" * 20_000 + "<script>" + "x " * 20_000 + "</script><b>last</b>", "<p>&copy;é" * 40_000]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id long, html string")
    df.coalesce(1).write.parquet(f"{tmp_path}/parts")
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    assert same(spark, tmp_path, "X05_html_parser")
    texts = [x["text"] for x in all_queries.QUERIES["X05_html_parser"](spark, str(tmp_path)).orderBy("page_id").collect()]
    assert [len(t) for t in texts] == [100_004, 100_004, 119_999] and texts[0].endswith("word last") and texts[1].endswith("word last")
