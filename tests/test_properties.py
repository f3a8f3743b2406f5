"""
option mutation checks, monotonic normalisation."""

import html
import re
from html.entities import name2codepoint
from urllib.parse import unquote

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from markhive import KeyOptions
from markhive.functions import decode_entities, decode_percent, escape_html
from markhive.operators import dedup

HEX = "0123456789abcdefABCDEF"
pct_piece = st.one_of(
    st.tuples(st.sampled_from(HEX), st.sampled_from(HEX)).map(lambda t: "%" + t[0] + t[1]),
    st.sampled_from(["%", "%z", "%zz", "+", "a", "/", "é", " ", "%E2%82", "%AC", "%C3"]),
)
pct_text = st.lists(pct_piece, max_size=12).map("".join)

SAFE_CP = st.one_of(st.integers(0x20, 0x7E), st.integers(0xA0, 0xD7FF), st.integers(0xE000, 0xFDCF))
ent_piece = st.one_of(
    st.sampled_from(sorted(name2codepoint)).map(lambda n: f"&{n};"),
    SAFE_CP.map(lambda c: f"&#{c};"),
    SAFE_CP.map(lambda c: f"&#x{c:x};"),
    st.text(alphabet="abc xyz<>\"'é;#", max_size=5),
)
ent_text = st.lists(ent_piece, max_size=10).map("".join)


def run_all(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def _fffd_runs(s):
    # How many U+FFFD an invalid byte sequence becomes differs: Python follows
    # the maximal-subpart rule (ED A0 -> 2), Java's decoder used by Spark
    # gives 1.  D4 only says invalid bytes become U+FFFD, so runs compare as one.
    return re.sub("\ufffd+", "\ufffd", s) if s is not None else s


@settings(max_examples=5, deadline=None)
@given(st.lists(pct_text, min_size=50, max_size=50))
def test_percent_decode_matches_unquote(spark, values):
    # One pass, UTF-8, '+' kept, malformed kept, bad bytes -> U+FFFD
    got = [_fffd_runs(v) for v in run_all(spark, values, decode_percent)]
    assert got == [_fffd_runs(unquote(v, errors="replace")) for v in values]


def test_invalid_utf8_becomes_replacement(spark):
    got = run_all(spark, ["%eD%a0x", "a%FFb", "%C3"], decode_percent)
    assert [_fffd_runs(g) for g in got] == ["\ufffdx", "a\ufffdb", "\ufffd"]


@settings(max_examples=5, deadline=None)
@given(st.lists(ent_text, min_size=50, max_size=50))
def test_entity_decode_matches_unescape(spark, values):
    # well-formed HTML 4 references with ';': html.unescape agrees
    assert run_all(spark, values, decode_entities) == [html.unescape(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=30, max_size=30))
def test_escape_decode_identity(spark, values):
    assert run_all(spark, values, lambda c: decode_entities(escape_html(c))) == values


def _kept(links, o):
    return {r.link_id for r in dedup.dedup(links, o, pos="link_id").select("link_id").collect()}


def test_every_option_changes_a_result(links01):
    base = KeyOptions(mode="url-title", profile="v2")
    ref = _kept(links01, base)
    for changed in (
        KeyOptions(mode="url", profile="v2"),
        KeyOptions(mode="url-title", profile="v2", decode=True),
        KeyOptions(mode="url-title", profile="v2", strict_protocol=True),
        KeyOptions(mode="url-title", profile="v2", ignore_slash=True),
        KeyOptions(mode="url-title", profile="v1"),
        KeyOptions(mode="url-title", profile="v3"),
    ):
        assert _kept(links01, changed) != ref, changed


def test_normalising_never_keeps_more(links01):
    for mode in ("url", "url-title"):
        strict = dedup.dedup(links01, KeyOptions(mode=mode, strict_protocol=True), pos="link_id").count()
        base = dedup.dedup(links01, KeyOptions(mode=mode), pos="link_id").count()
        slash = dedup.dedup(links01, KeyOptions(mode=mode, ignore_slash=True), pos="link_id").count()
        both = dedup.dedup(links01, KeyOptions(mode=mode, ignore_slash=True, decode=True), pos="link_id").count()
        assert strict >= base >= slash >= both


def test_result_independent_of_input_order(spark, links01):
    shuffled = links01.orderBy(F.rand(3)).repartition(5)
    a = dedup.batch_dedup(links01, KeyOptions(decode=True), "all", pos="link_id").select("mode", "link_id")
    b = dedup.batch_dedup(shuffled, KeyOptions(decode=True), "all", pos="link_id").select("mode", "link_id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
