"""Golden rows G1-G15 (FIXTURES.md section 3) and scalar edge cases."""

import pytest
from pyspark.sql import functions as F

from markhive import KeyOptions
from markhive.functions import (
    decode_entities,
    decode_percent,
    escape_html,
    fold_scheme,
    has_allowed_protocol,
    strip_trailing_slash,
    url_key,
    url_scheme,
    with_keys,
)


def keys_equal(spark, a, b, opts, title_a="t", title_b="t"):
    df = spark.createDataFrame([(a, title_a), (b, title_b)], "url string, title string")
    rows = with_keys(df, opts).select("key_url", "key_title").distinct().collect()
    return len(rows) == 1


GOLDEN = [
    ("G1", "http://example.com", "https://example.com", KeyOptions(), True),
    ("G2", "http://example.com", "https://example.com", KeyOptions(strict_protocol=True), False),
    ("G3", "http://example.com/page", "http://example.com/page/", KeyOptions(), False),
    ("G4", "http://example.com/page", "http://example.com/page/", KeyOptions(ignore_slash=True), True),
    ("G5", "http://example.com/a%20b", "http://example.com/a b", KeyOptions(), False),
    ("G6", "http://example.com/a%20b", "http://example.com/a b", KeyOptions(decode=True), True),
    ("G7", "http://e.com/?a=1&amp;b=2", "http://e.com/?a=1&b=2", KeyOptions(profile="v3"), True),
    ("G8a", "http://e.com/?a=1&amp;b=2", "http://e.com/?a=1&b=2", KeyOptions(profile="v2"), False),
    ("G8b", "http://e.com/?a=1&amp;b=2", "http://e.com/?a=1&b=2", KeyOptions(profile="v1"), False),
    ("G9a", "http://e.com/?a=1&amp;b=2", "http://e.com/?a=1&b=2", KeyOptions(profile="v2", decode=True), True),
    ("G9b", "http://e.com/?a=1&amp;b=2", "http://e.com/?a=1&b=2", KeyOptions(profile="v1", decode=True), True),
    ("G14", "a+b", "a b", KeyOptions(decode=True), False),
]


@pytest.mark.parametrize("gid,a,b,opts,same", GOLDEN, ids=[g[0] for g in GOLDEN])
def test_golden_urls(spark, gid, a, b, opts, same):
    assert keys_equal(spark, a, b, opts) == same


@pytest.mark.parametrize(
    "gid,opts,same",
    [
        ("G10a", KeyOptions(mode="url-title", profile="v2"), True),
        ("G10b", KeyOptions(mode="url-title", profile="v3"), True),
        ("G11", KeyOptions(mode="url-title", profile="v1"), False),
        ("G11d", KeyOptions(mode="url-title", profile="v1", decode=True), True),
    ],
)
def test_golden_titles(spark, gid, opts, same):
    assert keys_equal(spark, "http://x", "http://x", opts, "A &amp; B", "A & B") == same


def test_g12_g13_mode(spark):
    assert keys_equal(spark, "http://x", "http://x", KeyOptions(mode="url"), "x", "y")
    assert not keys_equal(spark, "http://x", "http://x", KeyOptions(mode="url-title"), "x", "y")


def test_g15_malformed_percent_kept(spark):
    df = spark.createDataFrame([("%zz",), ("%zz",)], "url string").withColumn("title", F.lit(""))
    rows = with_keys(df, KeyOptions(decode=True)).select("key_url").distinct().collect()
    assert [r.key_url for r in rows] == ["%zz"]


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize(
    "raw,decoded",
    [
        ("a &amp; b", "a & b"),
        ("&amp;lt;", "&lt;"),  # one pass only
        ("&lt;b&gt;", "<b>"),
        ("&#39;&#x41;&#X42;", "'AB"),
        ("&#128512;", "\U0001F600"),  # above U+FFFF
        ("&eacute;&Eacute;", "éÉ"),  # case matters
        ("?a=1&copy=2", "?a=1&copy=2"),  # no ';': kept
        ("&nosuch;", "&nosuch;"),
        ("a & b", "a & b"),
        ("&#0;", "�"),
        ("", ""),
    ],
)
def test_decode_entities(spark, raw, decoded):
    assert one(spark, decode_entities, raw) == decoded


def test_decode_entities_null(spark):
    assert spark.createDataFrame([(None,)], "v string").select(decode_entities("v").alias("o")).first().o is None


@pytest.mark.parametrize(
    "raw,decoded",
    [
        ("a%20b", "a b"),
        ("a+b", "a+b"),
        ("%zz", "%zz"),
        ("100%", "100%"),
        ("%C3%A9t%C3%A9", "été"),
        ("%65", "e"),
        ("%FF", "�"),
        ("x%2", "x%2"),
    ],
)
def test_decode_percent(spark, raw, decoded):
    assert one(spark, decode_percent, raw) == decoded


def test_decode_percent_long_run(spark):
    raw = "http://e.com/" + "%41" * 10000
    assert one(spark, decode_percent, raw) == "http://e.com/" + "A" * 10000


def test_scheme_and_slash(spark):
    assert one(spark, fold_scheme, "HTTPS://x/") == "//x/"
    assert one(spark, fold_scheme, "ftp://x") == "ftp://x"
    assert one(spark, strip_trailing_slash, "http://x/a//") == "http://x/a"
    assert one(spark, strip_trailing_slash, "http://x/?q=/") == "http://x/?q="
    assert one(spark, url_scheme, "JavaScript:void(0)") == "javascript"
    assert one(spark, url_scheme, "/relative") == ""


def test_protocol_filter(spark):
    urls = ["http://a", "HTTPS://b", "ftp://c", "javascript:void(0)", "mailto:x@y", "chrome://settings", "/x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    kept = sorted(r.url for r in df.where(has_allowed_protocol("url")).collect())
    assert kept == sorted(["http://a", "HTTPS://b", "ftp://c"])


def test_escape_then_decode_is_identity(spark):
    for s in ['a & b < c > "d"', "&amp;", "&lt;x&gt;", "plain", "é &#39;"]:
        df = spark.createDataFrame([(s,)], "v string")
        assert df.select(decode_entities(escape_html("v")).alias("o")).first().o == s


def test_url_key_order_of_steps(spark):
    # entity decode before percent decode; scheme fold; slash last (decision D6)
    df = spark.createDataFrame([("HTTP://x/a%2F&amp;/",)], "v string")
    out = df.select(url_key(F.col("v"), KeyOptions(decode=True, ignore_slash=True)).alias("o")).first().o
    assert out == "//x/a/&"


def test_functions_in_a_new_session(spark):
    other = spark.newSession()
    df = other.createDataFrame([("http://x/?a=1&amp;b=%41",)], "url string").withColumn("title", F.lit(""))
    row = with_keys(df, KeyOptions(decode=True)).first()
    assert row.key_url == "//x/?a=1&b=A"
