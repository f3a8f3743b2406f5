"""Extraction and folder paths (P1, P2, P3) on hand-written documents."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from markhive.operators import lexer
from markhive.operators.extract import extract_links, parse_bookmarks, resolve_tree, tokenize
from markhive.operators.ordered import last_before, rank_within, running_sum_before
from markhive.operators.tolerant import BookmarkEvents, parse_events, parse_tokens, tokenize_tolerant, tokens_of

NESTED = """<!DOCTYPE NETSCAPE-Bookmark-file-1>
<DL><p>
<DT><A HREF="http://root">root link</A>
<DT><H3 ADD_DATE="1">L1</H3>
<DL><p>
  <DT><H3>L2</H3>
  <DL><p>
    <DT><H3>L3</H3>
    <DL><p>
      <DT><H3>L4</H3>
      <DL><p>
        <DT><H3>L5</H3>
        <DL><p>
          <DT><H3>L6</H3>
          <DL><p>
            <DT><A HREF="http://deep">deep</A>
          </DL><p>
        </DL><p>
        <DT><A HREF="http://in-l4">in l4</A>
      </DL><p>
    </DL><p>
  </DL><p>
  <DT><H3>Empty</H3>
  <DL><p>
  </DL><p>
  <DT><a href='http://single'>single <b>bold</b></a>
  <DT><a HREF = http://unquoted>unquoted</a>
  <DT><A>no href</A>
  <DT><A HREF="">empty href</A>
</DL><p>
<DT><H3>Second</H3>
<DL><p>
  <DT><A HREF="http://x?a=1&amp;b=2">A &amp; B</A>
</DL><p>
</DL><p>
"""

FOLDERS_ONLY = "<DL><p><DT><H3>A</H3><DL><p><DT><H3>B</H3><DL><p></DL><p></DL><p></DL><p>"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [("nested", NESTED), ("empty", ""), ("folders", FOLDERS_ONLY)], "file_id string, html string"
    )


def _links(tree):
    return sorted(
        (r.file_id, "/".join(r.folder), r.url, r.title) for r in tree.links.collect()
    )


EXPECTED_LINKS = [
    ("nested", "", "http://root", "root link"),
    ("nested", "L1", "http://single", "single bold"),
    ("nested", "L1", "http://unquoted", "unquoted"),
    ("nested", "L1/L2/L3/L4", "http://in-l4", "in l4"),
    ("nested", "L1/L2/L3/L4/L5/L6", "http://deep", "deep"),
    ("nested", "Second", "http://x?a=1&amp;b=2", "A &amp; B"),
]

EXPECTED_FOLDERS = sorted(
    [("nested", p) for p in ["L1", "L1/L2", "L1/L2/L3", "L1/L2/L3/L4", "L1/L2/L3/L4/L5", "L1/L2/L3/L4/L5/L6",
                             "L1/Empty", "Second"]]
    + [("folders", "A"), ("folders", "A/B")]
)


def test_parse_bookmarks(docs):
    tree = parse_bookmarks(docs)
    assert _links(tree) == EXPECTED_LINKS
    got = sorted((r.file_id, "/".join(r.folder)) for r in tree.folders.collect())
    assert got == EXPECTED_FOLDERS


def test_folder_positions_follow_order(docs):
    tree = parse_bookmarks(docs)
    for r in tree.links.collect():
        assert list(r.folder_pos) == sorted(r.folder_pos)
        assert all(p < r.pos for p in r.folder_pos)


def test_small_chunks_give_same_tree(docs):
    # chunks of 3 tokens force every carry across chunks to be used
    tree = resolve_tree(tokenize(docs), chunk_rows=3)
    assert _links(tree) == EXPECTED_LINKS
    assert sorted((r.file_id, "/".join(r.folder)) for r in tree.folders.collect()) == EXPECTED_FOLDERS


def test_tolerant_same_as_regex_on_wellformed(docs):
    tree = resolve_tree(tokenize_tolerant(docs))
    assert _links(tree) == EXPECTED_LINKS


# Irregular documents and their tokens; both parsers must give them.
IRREGULAR = {
    "unclosed anchor": (
        "<DL><p><DT><A HREF='http://a'>first<DT><A HREF='http://b'>second</A></DL><p>",
        [("dl",), ("link", "http://a", "first"), ("link", "http://b", "second"), ("end",)],
    ),
    "odd quote after a value": ('<A HREF="http://q1" TITLE="it"s">q</A>', [("link", "http://q1", "q")]),
    "apostrophe in a bare value": ("<A HREF=http://p1 X=don't>p</A><A HREF='u2'>r</A>", [("link", "http://p1", "p"), ("link", "u2", "r")]),
    "quote that never closes": ('<A HREF="http://a" TITLE="oops>text</A><DT><A HREF=u>t', [("link", "http://a", "text"), ("link", "u", "t")]),
    "href whose quote never closes": ('<A HREF="http://a>text</A>', [("link", "http://a", "text")]),
    "comment": ('<!-- <A HREF="ghost">no</A> --><A HREF="u">a<!-- > "b -->c</A>', [("link", "u", "ac")]),
    "comment to the end": ('<A HREF="u">t</A><!-- <A HREF="ghost">no</A>', [("link", "u", "t")]),
    "short comments": ('<!--><A HREF="u">t</A><!---><A HREF="v">w</A><!-- x --!>', [("link", "u", "t"), ("link", "v", "w")]),
    "script": ("<script>a = '<A HREF=\"ghost\">no</A>'; b < c</script><A HREF='u'>t<style>x{}</style>z</A>", [("link", "u", "tz")]),
    "script to the end": ("<A HREF='u'>t</A><script><A HREF='ghost'>no</A>", [("link", "u", "t")]),
    "tag in a value": ("<A TITLE='<A HREF=\"ghost\">' HREF='u'>t</A>", [("link", "u", "t")]),
    "href in another value": ('<A TITLE="x href=\'ghost\'" DATA-HREF="ghost" HREF="u">t</A>', [("link", "u", "t")]),
    "angle bracket in a value": ('<A HREF="javascript:a>b">t</A>', [("link", "javascript:a>b", "t")]),
    "lone brackets": ("1 < 2 <A HREF=u>a < b <> c</A> <", [("link", "u", "a < b <> c")]),
    "names that begin like tags": ("<ABBR>x</ABBR><DLX><H33><A HREF=u>t</ABBR></A><DTX>", [("link", "u", "t")]),
    "closed by the other end tag": ("<H3>f</A><DL><A HREF=u>t</H3>rest</DL>", [("folder", "f"), ("dl",), ("link", "u", "t"), ("end",)]),
    "slash before the end": ("<A HREF='u'/>t</A><A HREF=v/>w</A>", [("link", "u", "t"), ("link", "v/", "w")]),
    "declarations": ("<!DOCTYPE x><?pi ghost?><![CDATA[x]]><A HREF=u>t</A>", [("link", "u", "t")]),
    "entities": ("<A HREF=u>&#x; &amp &amp; &#39</A><A HREF=v>&#;</A>", [("link", "u", "&#x; &amp &amp; &#39"), ("link", "v", "&#;")]),
    "list ends": ("<DL></DL x><dl/></dl", [("dl",), ("end",), ("dl",)]),
    "nothing": ("", []),
}


def _brief(kind, name, url, title):
    return {"link": (kind, url, title), "folder": (kind, name)}.get(kind, (kind,))


@pytest.mark.parametrize("case", IRREGULAR)
def test_irregular_documents(case):
    html, wanted = IRREGULAR[case]
    got = [_brief(*t) for t in parse_events(html)]
    assert got == wanted


def test_both_parsers_give_the_same_tokens(spark):
    rows = [(k, html) for k, (html, _) in IRREGULAR.items()] + [(f"{a}+{b}", IRREGULAR[a][0] + IRREGULAR[b][0]) for a in IRREGULAR for b in IRREGULAR]
    df = spark.createDataFrame(rows, "file_id string, html string")
    regex, tolerant = (sorted(map(tuple, t.collect()), key=str) for t in (tokenize(df), tokenize_tolerant(df)))
    assert len(regex) > 700 and regex == tolerant


FRAGMENTS = [
    "<A", "<a ", "HREF=", '"http://x"', "'y'", '"', "'", ">", "/>", "</A>", "</a >", "<H3>", "</H3>", "<DL>", "<p>", "</DL>", "<DT>", "<DD>", "<HR>",
    "<!--", "-->", "--!>", "<!-", "->", "<script>", "</script>", "</scr", "<style", "</style x>", "<", "text", "&amp;", "&#x;", "=", " ", "\n", "/",
    "<b>", "<?pi", "<!doctype", "x=y", "don't", "é", "</", "</dl", 'title="it"s"', "\x0b", '<DT><A HREF="u">t',
]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(FRAGMENTS), max_size=25), st.integers(1, 9))
def test_pieces_of_any_size_give_the_same_tokens(parts, size):
    html = "".join(parts)
    assert list(tokens_of(html[i : i + size] for i in range(0, len(html), size))) == parse_tokens(html)
    assert "".join(m[1] for m in lexer.compiled(lexer.SEGMENT_RE).finditer(html)) == html


def test_random_documents_in_both_parsers(spark):
    rng = random.Random(3)
    rows = [(str(i), "".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(1, 25)))) for i in range(4000)]
    df = spark.createDataFrame(rows, "file_id string, html string")
    regex, tolerant = (sorted(map(tuple, t.collect()), key=str) for t in (tokenize(df), tokenize_tolerant(df)))
    assert len(regex) > 1000 and regex == tolerant


def test_long_irregular_documents(spark):
    n = 100_000
    rows = [
        ("comment", "<!--" + "-a" * n, 0),
        ("value", '<a href="' + "x" * n, 0),
        ("unclosed", '<a href="u">t' + "<br>\n" * n, 1),
        ("brackets", "<" * n, 0),
        ("script", "<script>" + "<a " * n, 0),
        ("links", "<DT><A HREF='u'>t" * n, n),
    ]
    df = spark.createDataFrame(rows, "file_id string, html string, n int")
    for tokens in (tokenize(df), tokenize_tolerant(df)):
        assert {r["file_id"]: r["count"] for r in tokens.groupBy("file_id").count().collect()} == {k: n for k, _, n in rows if n}


def test_parser_memory_does_not_follow_the_document():
    p = BookmarkEvents()
    for opening, filler in (("", "<DT><A HREF='u'>t</A>\n"), ("<!--", "- text -"), ("--><script>", "a < b;")):
        p.feed(opening)
        for _ in range(2000):
            p.feed(filler)
            p.tokens.clear()
            assert len(p.rawdata) < 64


def test_tolerant_keeps_raw_entities():
    toks = parse_events('<A HREF="http://x?a=1&amp;b=2">a &amp; b &amp c &#39;x&#39 & d</A>')
    assert toks == [("link", None, "http://x?a=1&amp;b=2", "a &amp; b &amp c &#39;x&#39 & d")]


def test_extract_links_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    from markhive.sources.documents import pages_documents

    links = extract_links(pages_documents(pages))
    assert links.count() == 281
    assert links.where("url = '' or url is null").count() == 0


def test_running_sum_and_last_before_across_chunks(spark):
    rows = [("d", i, 1 if i % 3 == 0 else 0, f"m{i}" if i % 4 == 0 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "doc string, pos bigint, v int, m string").withColumn(
        "chunk", F.floor(F.col("pos") / 5).cast("bigint")
    )
    out = last_before(running_sum_before(df, ["doc"], "pos", "chunk", "v", "s"), ["doc"], "pos", "chunk", "m", "last")
    got = {r.pos: (r.s, r["last"]) for r in out.collect()}
    for i in range(20):
        assert got[i][0] == sum(1 for j in range(i) if j % 3 == 0)
        prev = [j for j in range(i) if j % 4 == 0]
        assert got[i][1] == (f"m{prev[-1]}" if prev else None)


def test_rank_within_hot_group(spark):
    # one group holds most rows; ranks must still be 1..n in order
    rows = [("hot", f"p{i:04d}") for i in range(300)] + [("cold", "a"), ("cold", "b")]
    df = spark.createDataFrame(rows, "g string, path string")
    out = rank_within(df, ["g"], "path", "rk", chunks=6).collect()
    hot = sorted((r.path, r.rk) for r in out if r.g == "hot")
    assert [rk for _, rk in hot] == list(range(1, 301))
    assert sorted((r.path, r.rk) for r in out if r.g == "cold") == [("a", 1), ("b", 2)]
