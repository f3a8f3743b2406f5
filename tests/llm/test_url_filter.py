import os

import duckdb
from pyspark.sql import functions as F

from markhive.llm import url_filter

URLS = [
    "http://EXAMPLE.org/es/1", "https://a.example.org/en/1?x", "https://a.example.org/en/2#t", "http://xexample.org/es/1", "http://com/de/", "http://x.com", "http://x.com/fr/",
    "ftp://blog.spam-farm.example.net/a://b", "no scheme", "", None, "://", "http://cheap-pills.de?x=http://a/b", "http://spam-farm/", "x\ny://host.org/p\nq?r",
]


def pages(spark):
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, html string")


def test_equals_its_sql(spark, tmp_path):
    path = os.path.join(tmp_path, "pages.parquet")
    pages(spark).toPandas().to_parquet(path)
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{path}'")
    want = sorted(con.sql(url_filter.ORACLE_SQL).fetchall())
    assert sorted(map(tuple, url_filter.judge(pages(spark)).collect())) == want


def test_cascade_is_exact(spark):
    n = 20_000
    universe = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), (F.xxhash64("id") % 7 == 0).alias("listed"))
    keys = universe.withColumn("again", F.col("listed"))
    got = url_filter.with_listed(keys.drop("listed").unionAll(keys.drop("listed").limit(50)), "key", universe)
    assert got.where("listed <> again").count() == 0 and got.count() == n + 50
    assert len(url_filter.build(universe)) > 2


def test_too_large_a_cascade_is_dealt_to_shards(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARD_KEYS", 100)
    universe = spark.range(1000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    assert url_filter.build(universe, max_bits=64) is None
    # a third of the rows has one key; the columns' names are those that the shards use
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, "33").otherwise((F.col("id") % 1000).cast("string")).alias("key"), F.col("id").alias("shard"), F.lit(None).cast("string").alias("row"))
    got = url_filter.with_listed(rows, "key", universe, max_bits=64)
    assert got.columns == ["key", "shard", "row", "listed"] and got.select("shard").distinct().count() == 3000
    assert got.where(F.col("listed") != (F.col("key").cast("long") % 3 == 0)).count() == 0
    none = universe.withColumn("listed", F.lit(False))
    assert url_filter._with_listed_by_shards(rows, "key", none, "listed").where("listed").count() == 0
    assert url_filter._with_listed_by_shards(rows.limit(0), "key", universe.limit(0), "listed").count() == 0


def test_nothing_listed_or_nothing_at_all(spark):
    universe = spark.createDataFrame([("a", False), ("b", False)], "key string, listed boolean")
    assert url_filter.build(universe) == []
    assert url_filter.with_listed(universe.select("key"), "key", universe).where("listed").count() == 0
    assert url_filter.judge(pages(spark).limit(0)).count() == 0
