"""Hot keys and hot files: one URL holds a third of all rows.

Results are checked against a pandas brute force on the same rows, and
the plans are checked for the partial steps that keep a hot key off a
single task.
"""

import pytest
from pyspark.sql import functions as F

from markhive import CompareOptions, KeyOptions
from markhive.operators import compare, dedup

HOT = "http://hot.example.com/"


@pytest.fixture(scope="module")
def hot_links(links01):
    # every third link points at the same URL, in every file
    return links01.withColumn("url", F.when(F.col("link_id") % 3 == 0, F.lit(HOT)).otherwise(F.col("url"))).cache()


def test_hot_key_dedup_matches_brute_force(hot_links):
    pdf = hot_links.toPandas()
    assert (pdf.url == HOT).mean() > 0.3
    o = KeyOptions(strict_protocol=True, profile="v2")  # v2 without -d: the key is the raw URL
    want = set(pdf.sort_values("link_id").drop_duplicates(["file_id", "url"]).link_id)
    got = {r.link_id for r in dedup.dedup(hot_links, o, pos="link_id").select("link_id").collect()}
    assert got == want
    gone = dedup.removed(hot_links, o, pos="link_id")
    assert gone.count() == len(pdf) - len(want)


def test_hot_key_presence_matches_brute_force(hot_links):
    from markhive.functions import decode_entities

    # compare keys are v3: entities decoded, scheme strict, slash kept
    pdf = hot_links.select("file_id", decode_entities("url").alias("k")).toPandas()
    want = pdf.groupby("k").file_id.nunique().to_dict()
    got = {r.key_url: r.n_files for r in compare.presence(hot_links, CompareOptions()).collect()}
    assert got == want


def _plan(df):
    df.count()
    return df._jdf.queryExecution().executedPlan().toString()


def test_partial_steps_before_shuffles(hot_links):
    plan = _plan(dedup.dedup(hot_links, KeyOptions(), pos="link_id"))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    report = compare.multi_compare(hot_links, None, hot_links.select("file_id").distinct(), CompareOptions(), pos="link_id")
    plan = _plan(report)
    assert "partial_min" in plan and "partial_count" in plan
    assert "Scan parquet" not in plan  # links were read once, into the checkpoint that all branches share
    assert "SortAggregate" not in plan
    diff = compare.diff_report(hot_links, None, "f0", "f1", CompareOptions(), pos="link_id")
    assert "SortAggregate" not in _plan(diff)


def test_hot_file(spark, links01):
    # one file holds almost everything; batch dedup per file stays correct
    one = links01.withColumn("file_id", F.when(F.col("link_id") % 10 != 0, F.lit("big")).otherwise(F.col("file_id")))
    got = dedup.batch_dedup(one, KeyOptions(), "all", pos="link_id").groupBy("mode").count().collect()
    pdf = one.toPandas()
    kept_url = dedup.dedup(one, KeyOptions(), pos="link_id").count()
    assert {r["mode"]: r["count"] for r in got}["url"] == kept_url
    assert len(pdf) == 1413
