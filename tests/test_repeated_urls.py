"""Crawl queries against their SQL where several pages have one URL."""

import pytest

import __spark_entry__

URLS = ["https://a.org/1", "https://a.org/2", "https://b.net/3", "https://b.net/three"]


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Pages of which each URL has cached, stale and missing ones."""
    d = tmp_path_factory.mktemp("repeated")
    spark.createDataFrame([(i, URLS[i % 3 if i < 24 else 3], "") for i in range(30)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{d}/pages.parquet")
    return str(d)


def same_as_sql(spark, d, name):
    duckdb = pytest.importorskip("duckdb")
    got = __spark_entry__.queries()[name](spark, d)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_cache_of_pages_with_one_url(spark, repeated):
    same_as_sql(spark, repeated, "s12_cache_hits")


def test_fetch_of_pages_with_one_url(spark, repeated):
    same_as_sql(spark, repeated, "s12_fetch")


def test_crawl_of_pages_with_one_url(spark, repeated):
    same_as_sql(spark, repeated, "s15_polite_crawl")
