"""Dedup family (A1-A8, F2, F3) on the links fixture at sf0.01.

Expected counts are the table in FIXTURES.md section 2 (distinct keys per
file = rows kept).
"""

import pytest
from pyspark.sql import functions as F

from markhive import KeyOptions
from markhive.operators import dedup

# profile, -d, mode -> (base, strict, slash)
EXPECTED = {
    ("v1", False, "url"): (1130, 1144, 1069),
    ("v1", False, "url-title"): (1356, 1367, 1336),
    ("v2", False, "url"): (1130, 1144, 1069),
    ("v2", False, "url-title"): (1295, 1308, 1253),
    ("v3", False, "url"): (1101, 1117, 1040),
    ("v3", False, "url-title"): (1277, 1292, 1235),
}
for _p in ("v1", "v2", "v3"):
    EXPECTED[(_p, True, "url")] = (1073, 1091, 999)
    EXPECTED[(_p, True, "url-title")] = (1259, 1277, 1209)


@pytest.mark.parametrize("profile,decode,mode", sorted(EXPECTED), ids=lambda x: str(x))
def test_kept_counts(links01, profile, decode, mode):
    base = KeyOptions(mode=mode, decode=decode, profile=profile)
    variants = [base, KeyOptions(mode=mode, decode=decode, profile=profile, strict_protocol=True),
                KeyOptions(mode=mode, decode=decode, profile=profile, ignore_slash=True)]
    got = tuple(dedup.dedup(links01, o, pos="link_id").count() for o in variants)
    assert got == EXPECTED[(profile, decode, mode)]


def test_input_has_duplicates(links01):
    # trap: without the fixture's variants a no-op dedup would pass
    assert links01.count() == 1413
    assert links01.select("file_id", "url").distinct().count() == 1144


def test_kept_plus_removed_is_input(links01):
    o = KeyOptions()
    kept = dedup.dedup(links01, o, pos="link_id").select("link_id")
    gone = dedup.removed(links01, o, pos="link_id").select("link_id")
    assert kept.count() + gone.count() == links01.count()
    assert kept.union(gone).distinct().count() == links01.count()


def test_removed_points_at_kept(links01):
    o = KeyOptions()
    kept = dedup.dedup(links01, o, pos="link_id").select("file_id", "key_url", F.col("link_id").alias("kept_pos"))
    gone = dedup.removed(links01, o, pos="link_id")
    assert gone.join(kept, ["file_id", "key_url", "kept_pos"], "left_anti").count() == 0
    assert gone.where(F.col("link_id") <= F.col("kept_pos")).count() == 0


def test_first_occurrence_kept(links01):
    kept = dedup.dedup(links01, KeyOptions(), pos="link_id")
    firsts = links01.transform(lambda d: dedup.mark_duplicates(d, KeyOptions(), pos="link_id")).where(
        ~F.col("is_duplicate")
    )
    assert sorted(r.link_id for r in kept.select("link_id").collect()) == sorted(
        r.link_id for r in firsts.select("link_id").collect()
    )


def test_idempotent_and_unique(links01):
    o = KeyOptions(mode="url-title", decode=True)
    once = dedup.dedup(links01, o, pos="link_id").drop("key_url", "key_title")
    twice = dedup.dedup(once, o, pos="link_id")
    assert once.count() == twice.count()
    assert twice.groupBy("file_id", "key_url", "key_title").count().where("count > 1").count() == 0


def test_url_not_more_than_url_title(links01):
    for p in ("v1", "v2", "v3"):
        a = dedup.dedup(links01, KeyOptions(mode="url", profile=p), pos="link_id").count()
        b = dedup.dedup(links01, KeyOptions(mode="url-title", profile=p), pos="link_id").count()
        assert a <= b


def test_batch_all_is_union_of_modes(links01):
    o = KeyOptions(decode=True)
    both = dedup.batch_dedup(links01, o, "all", pos="link_id")
    u = dedup.batch_dedup(links01, o, "url", pos="link_id")
    t = dedup.batch_dedup(links01, o, "url-title", pos="link_id")
    cols = ["mode", "link_id"]
    assert both.select(cols).exceptAll(u.select(cols).unionByName(t.select(cols))).count() == 0
    assert both.count() == u.count() + t.count()
    assert u.count() == dedup.dedup(links01, o, pos="link_id").count()


def test_independent_of_partitioning(spark, links01):
    o = KeyOptions(mode="url-title")
    a = dedup.dedup(links01, o, pos="link_id").select("link_id")
    b = dedup.dedup(links01.repartition(17, "url").sortWithinPartitions(F.rand(7)), o, pos="link_id").select("link_id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_files_never_mix(spark):
    df = spark.createDataFrame(
        [("f1", 0, "http://a", "x"), ("f2", 0, "http://a", "x"), ("f1", 1, "https://a", "y")],
        "file_id string, pos bigint, url string, title string",
    )
    kept = dedup.dedup(df, KeyOptions())
    assert sorted((r.file_id, r.pos) for r in kept.collect()) == [("f1", 0), ("f2", 0)]


def test_link_counts_keeps_empty_files(spark):
    files = spark.createDataFrame([("a",), ("b",), ("empty",)], "file_id string")
    links = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "file_id string, pos int")
    got = {r.file_id: r.n_links for r in dedup.link_counts(files, links).collect()}
    assert got == {"a": 2, "b": 1, "empty": 0}


def test_window_group_limit_in_plan(links01):
    plan = dedup.dedup(links01, KeyOptions(), pos="link_id")._jdf.queryExecution().executedPlan().toString()
    # the partial limit runs before the exchange (skew-safe for hot keys)
    assert "WindowGroupLimit" in plan or "AdaptiveSparkPlan" in plan
