"""Test inputs derived from the driver's ``pages`` table.

``pages`` has no duplicate URLs and no bookmark structure, so the ``links``
fixture gives each anchor deterministic URL/title variants, a file (f0, f1,
f2) and a folder path.  The rules are the ones written down in FIXTURES.md
section 2; the DuckDB oracle in ``__spark_entry__`` states them in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extract import tokenize
from ..operators.render import NETSCAPE_FOOTER, NETSCAPE_HEADER, items_from_links, render_documents


def links_fixture(pages: DataFrame) -> DataFrame:
    """``(link_id, file_id, folder, url, title)`` plus ``page_id``; raw text."""
    anchors = links_of_with_page(pages)
    page_id, pos, page_url = F.col("page_id"), F.col("pos"), F.col("page_url")
    href, t = F.col("href"), F.col("t")
    sq = page_id * page_id
    v = (sq + pos * 17) % 101 % 16
    file_id = F.concat(F.lit("f"), ((sq + pos * 3) % 1009 % 3).cast("string"))
    folder = F.concat(
        F.lit("Bar/"),
        F.regexp_extract(page_url, r"^https?://[^/]+/([a-z][a-z])/", 1),
        F.when(pos % 2 == 0, F.concat(F.lit("/"), F.regexp_extract(page_url, r"example[.]([a-z]+)", 1))).otherwise(""),
        F.when(page_id % 50 == 7, F.lit("/only")).otherwise(""),
    )
    tail = (
        F.when(v.isin(2, 3), F.concat(href, F.lit("/")))
        .when(v.isin(4, 5), F.replace(F.replace(href, F.lit("e"), F.lit("%65")), F.lit("é"), F.lit("%C3%A9")))
        .when(v.isin(6, 7), F.concat(href, F.lit("?a=1&amp;b=2")))
        .when(v.isin(8, 9), F.concat(href, F.lit("?a=1&b=2")))
        .when(v == 10, F.concat(href, F.lit("?q=a+b%zz")))
        .otherwise(href)
    )
    url = (
        F.when(v == 0, F.lit("javascript:void(0)"))
        .when(v == 1, F.concat(F.lit("ftp://example.com"), href))
        .otherwise(F.concat(F.regexp_extract(page_url, r"^(https?)", 1), F.lit("://example.com"), tail))
    )
    title = (
        F.when(sq % 7 < 2, F.concat(t, F.lit(" &amp; co")))
        .when(sq % 7 == 2, F.concat(t, F.lit(" & co")))
        .otherwise(t)
    )
    return anchors.select(
        (page_id * 1000 + pos).alias("link_id"),
        file_id.alias("file_id"),
        folder.alias("folder"),
        url.alias("url"),
        title.alias("title"),
        page_id.alias("page_id"),
    )


def links_of_with_page(pages: DataFrame) -> DataFrame:
    """Anchors of each page with the page's id and URL: ``pos``, ``href``, ``t``."""
    docs = pages.select("page_id", F.col("url").alias("page_url"), "html")
    toks = tokenize(docs, doc="page_id", html="html", anchors_only=True, keep=["page_url"])
    return toks.select("page_id", "pos", F.col("url").alias("href"), F.col("title").alias("t"), "page_url")


def fixture_paths(pages: DataFrame, kind: str) -> DataFrame:
    """A file path per page, derived from its URL: ``(page_id, path)``.

    JSON: every third page is a Chromium ``Bookmarks`` file in its own
    folder, the others are ``p<id>.json`` files that share a host folder.
    HTML: ``p<id>.html`` files in host folders.
    """
    lang = F.regexp_extract("url", r"^https?://[^/]+/([a-z][a-z])/", 1)
    host = F.regexp_extract("url", r"^https?://([^/:]+)", 1)
    base = F.concat(F.lit("/exports/"), lang, F.lit("/"), host, F.lit("/"))
    pid = F.col("page_id").cast("string")
    if kind == "json":
        path = F.when(
            F.col("page_id") % 3 == 0, F.concat(base, pid, F.lit("/Bookmarks"))
        ).otherwise(F.concat(base, F.lit("p"), pid, F.lit(".json")))
    else:
        path = F.concat(base, F.lit("p"), pid, F.lit(".html"))
    return pages.select("page_id", path.alias("path"))


def fixture_documents(pages: DataFrame, fmt: str) -> DataFrame:
    """One bookmark document per page, holding that page's fixture links.

    ``(page_id, file_id, path, text)``; ``file_id`` is the page id as text.
    ``fmt`` is ``html`` (raw values written as they are, like a file whose
    text was never decoded) or ``json`` (values as JSON strings).  Pages
    without links give an empty document.  A page is one row, so each
    document is bounded by one input row.
    """
    links = links_fixture(pages).withColumn("doc", F.col("page_id").cast("string"))
    items = items_from_links(links, doc="doc", folder="folder", pos="link_id")
    docs = render_documents(items, fmt=fmt, escape=False)
    paths = fixture_paths(pages, fmt).withColumn("doc", F.col("page_id").cast("string"))
    empty_text = EMPTY_DOCUMENT[fmt]
    return paths.join(docs, "doc", "left").select(
        "page_id", F.col("doc").alias("file_id"), "path", F.coalesce("text", F.lit(empty_text)).alias("text")
    )


FLAT_HEAD, FLAT_END = NETSCAPE_HEADER + "\n", "</DL><p>\n<!-- the end -->\n"


def flat_pieces(links: DataFrame, doc: str = "file_id") -> DataFrame:
    """Bookmark documents without folders as ordered pieces: ``(doc, k, text)``.

    A link's piece is its line, for every third one with a note, and for every
    fifth with a rule behind it; a head and an end come with each document.
    """
    link_id = F.col("link_id")
    line = F.concat(F.lit('    <DT><A HREF="'), "url", F.lit('" ADD_DATE="'), link_id.cast("string"), F.lit('">'), "title", F.lit("</A>\n"))
    note = F.when(link_id % 3 == 0, F.concat(F.lit("    <DD>note "), link_id.cast("string"), F.lit("\n"))).otherwise("")
    rule = F.when(link_id % 5 == 0, F.lit("    <HR>\n")).otherwise("")
    body = links.select(F.col(doc).alias("doc"), link_id.alias("k"), F.concat(line, note, rule).alias("text"))
    docs = body.select("doc").distinct()
    head = docs.select("doc", F.lit(-1).cast("bigint").alias("k"), F.lit(FLAT_HEAD).alias("text"))
    end = docs.select("doc", F.lit(1 << 62).cast("bigint").alias("k"), F.lit(FLAT_END).alias("text"))
    return head.unionByName(body).unionByName(end)


EMPTY_DOCUMENT = {
    "json": '{"roots":{"bookmark_bar":{"type":"folder","name":"Bookmarks bar","children":[]}}}',
    "html": NETSCAPE_HEADER + "\n" + NETSCAPE_FOOTER + "\n",
}
