"""URL rules and the filter cascade (2)."""

import pytest
from pyspark.sql import functions as F

from plurivote.llm import url_filter
from plurivote.llm.queries import RULES

URLS = [
    ("http://Sub.Example.ORG/es/x?q#f", "sub.example.org", "/es/x", "example.org/es/", "block"),
    ("https://example.org/en/1", "example.org", "/en/1", "example.org/en/1", "block"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("https://example.org", "example.org", "", None, "allow"),
    ("https://example.org?x=/es/", "example.org", "", None, "allow"),
    ("ftp://a.com/fr/1", "a.com", "/fr/1", "com/fr/", "allow"),
    ("ftp://a.com/de/1", "a.com", "/de/1", "com/de/", "block"),
    ("x://com/de/", "com", "/de/", "com/de/", "block"),
    ("http://bad.net/a", "bad.net", "/a", None, "block"),
    ("http://BAD.net/a#b", "bad.net", "/a", None, "block"),
    ("http://bad.net/b", "bad.net", "/b", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("://", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://ÄÖ.net/Ü\n?", "ÄÖ.net", "/Ü\n", None, "allow"),
]


def test_rules_and_list(spark):
    pages = spark.createDataFrame([(i, u[0], "x", 1) for i, u in enumerate(URLS)] + [(None, URLS[0][0], None, None)], "page_id int, url string, host string, shard int")
    listed = spark.createDataFrame([("bad.net/a",), ("bad.net/a",), ("never.net/seen",)], "key string")
    got = url_filter.filter_urls(pages, RULES, listed).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        want = URLS[0 if r["page_id"] is None else r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want[1:], want


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id int, url string")
    keys = spark.createDataFrame([], "key string")
    assert url_filter.filter_urls(pages, RULES, keys).collect() == []
    some = spark.createDataFrame([(1, "http://bad.net/a")], "page_id int, url string")
    assert [r["verdict"] for r in url_filter.filter_urls(some, RULES, keys).collect()] == ["allow"]


@pytest.mark.parametrize("per_shard, broadcast", [(1 << 14, 32 << 20), (40, 0)])
def test_membership_is_exact(spark, monkeypatch, per_shard, broadcast):
    """Every key of the universe, many shards, several levels, with and without broadcast."""
    monkeypatch.setattr(url_filter, "KEYS_PER_SHARD", per_shard)
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_BYTES", broadcast)
    pages = spark.range(6000).selectExpr("id AS page_id", "concat('http://h', id % 900, '.net/p', id % 3000) AS url")
    hot = spark.range(2000).selectExpr("id + 6000 AS page_id", "'http://hot.net/' AS url")
    listed = spark.range(0, 3000, 11).selectExpr("concat('h', id % 900, '.net/p', id % 3000) AS key")
    want = {r["key"] for r in listed.collect()}
    got = url_filter.filter_urls(pages.unionByName(hot), [], listed).collect()
    assert len(got) == 8000
    assert all(r["listed"] == (r["host"] + r["path"] in want) for r in got)


def test_levels_stay_small(spark, monkeypatch):
    """A short list over a large universe: the shards are as many as the false positives need."""
    monkeypatch.setattr(url_filter, "KEYS_PER_SHARD", 64)
    universe = spark.range(60_000).selectExpr("concat('k', id) AS key")
    listed = spark.range(10).selectExpr("concat('k', id * 7) AS key")
    cascade, shards = url_filter.build_cascade(listed, universe)
    assert shards >= 50
    widest = cascade.selectExpr("explode(levels) AS l").selectExpr("max(size(l.words)) AS w").first()["w"]
    assert widest * 64 <= 4 * 64 * url_filter.BITS_PER_KEY
    held = universe.withColumn("shard", url_filter.shard_of(F.col("key"), shards)).join(cascade, "shard", "left")
    got = {r["key"] for r in held.where(url_filter.is_listed(F.col("key"), F.col("levels"))).collect()}
    assert got == {f"k{7 * i}" for i in range(10)}


def test_null_keys(spark):
    """A null key is not listed and does not keep the cascade from ending."""
    universe = spark.createDataFrame([(None,), ("a",), ("b",)], "key string")
    cascade, shards = url_filter.build_cascade(spark.createDataFrame([(None,), ("a",)], "key string"), universe)
    held = universe.withColumn("shard", url_filter.shard_of(F.col("key"), shards)).join(cascade, "shard", "left")
    got = held.select("key", url_filter.is_listed(F.col("key"), F.col("levels")).alias("listed")).where("key IS NOT NULL").collect()
    assert {r["key"]: r["listed"] for r in got} == {"a": True, "b": False}


def test_list_longer_than_the_universe(spark):
    pages = spark.range(50).selectExpr("id AS page_id", "concat('http://h', id, '.net/') AS url")
    listed = spark.range(20_000).selectExpr("concat('h', id * 10, '.net/') AS key")
    got = url_filter.filter_urls(pages, [], listed).where("listed").collect()
    assert sorted(r["page_id"] for r in got) == [0, 10, 20, 30, 40]
