"""JSON flattening (P4), rendering (P5) and conversion round trips."""

import json

from pyspark.sql import functions as F

from markhive.functions import decode_entities
from markhive.operators.extract import parse_bookmarks
from markhive.operators.jsontree import FIREFOX, flatten_json, items_from_json, json_folders, json_links
from markhive.operators.render import items_from_links, render_documents

CHROME = {
    "roots": {
        "bookmark_bar": {"type": "folder", "name": "Bar", "children": [
            {"type": "url", "name": "x <&> \"q\"", "url": "http://x?a=1&b=2"},
            {"type": "folder", "name": "Sub", "children": [
                {"type": "url", "name": "y", "url": "http://y"},
                {"type": "folder", "name": "Deep", "children": [
                    {"type": "folder", "name": "Deeper", "children": [
                        {"type": "folder", "name": "Deepest", "children": [
                            {"type": "url", "name": "z", "url": "http://z"}]}]}]}]},
            {"type": "folder", "name": "Empty", "children": []},
            {"type": "url", "name": "after", "url": "http://after"}]},
        "other": {"type": "folder", "name": "Other", "children": [{"type": "url", "name": "o", "url": "http://o"}]},
    },
    "version": 1,
}

FIREFOX_DOC = {
    "title": "", "children": [
        {"title": "menu", "children": [{"title": "m1", "uri": "http://m1"}, {"title": "sep", "type": "separator"}]},
        {"title": "top", "uri": "http://top"},
    ],
}


def test_flatten_chromium(spark):
    docs = spark.createDataFrame([("a/Bookmarks", json.dumps(CHROME)), ("bad", "{not json")], "path string, js string")
    nodes = flatten_json(docs)
    links = sorted((r.doc, "/".join(r.folder), r.url, r.title) for r in json_links(nodes).collect())
    assert links == [
        ("a/Bookmarks", "Bar", "http://after", "after"),
        ("a/Bookmarks", "Bar", "http://x?a=1&b=2", 'x <&> "q"'),
        ("a/Bookmarks", "Bar/Sub", "http://y", "y"),
        ("a/Bookmarks", "Bar/Sub/Deep/Deeper/Deepest", "http://z", "z"),
        ("a/Bookmarks", "Other", "http://o", "o"),
    ]
    folders = sorted("/".join(r.folder) for r in json_folders(nodes).collect())
    assert folders == ["Bar", "Bar/Empty", "Bar/Sub", "Bar/Sub/Deep", "Bar/Sub/Deep/Deeper",
                       "Bar/Sub/Deep/Deeper/Deepest", "Other"]


def test_document_order(spark):
    docs = spark.createDataFrame([("d", json.dumps(CHROME))], "path string, js string")
    ordered = sorted(json_links(flatten_json(docs)).collect(), key=lambda r: list(r.ord))
    assert [r.url for r in ordered] == ["http://x?a=1&b=2", "http://y", "http://z", "http://after", "http://o"]


def test_flatten_firefox(spark):
    docs = spark.createDataFrame([("ff.json", json.dumps(FIREFOX_DOC))], "path string, js string")
    links = sorted((("/".join(r.folder)), r.url, r.title) for r in json_links(flatten_json(docs, fields=FIREFOX)).collect())
    assert links == [("", "http://top", "top"), ("menu", "http://m1", "m1")]


def test_json_to_html_round_trip(spark):
    docs = spark.createDataFrame([("d", json.dumps(CHROME))], "path string, js string")
    nodes = flatten_json(docs)
    html = render_documents(items_from_json(nodes), fmt="html", escape=True)
    text = html.first().text
    assert text.startswith("<!DOCTYPE NETSCAPE-Bookmark-file-1>")
    assert "&lt;&amp;&gt; &quot;q&quot;" not in text  # titles are not quote-escaped
    tree = parse_bookmarks(html.select(F.col("doc").alias("file_id"), F.col("text").alias("html")))
    back = sorted(
        (r.folder, r.url, r.title)
        for r in tree.links.select(
            F.array_join("folder", "/").alias("folder"), decode_entities("url").alias("url"), decode_entities("title").alias("title")
        ).collect()
    )
    want = sorted(("/".join(r.folder), r.url, r.title) for r in json_links(nodes).collect())
    assert back == want
    # document order survives: link order in the HTML equals the JSON order
    order = [r.url for r in sorted(tree.links.collect(), key=lambda r: r.pos)]
    assert [decode_entities_py(u) for u in order] == ["http://x?a=1&b=2", "http://y", "http://z", "http://after", "http://o"]
    # the empty folder is kept
    assert sorted("/".join(r.folder) for r in tree.folders.collect()).count("Bar/Empty") == 1


def decode_entities_py(s):
    import html as h

    return h.unescape(s)


def test_links_to_json_is_valid_and_flattens_back(spark):
    links = spark.createDataFrame(
        [("d", 0, "A/B", "http://1", 't "1"'), ("d", 1, "A", "http://2", "t2"), ("d", 2, "", "http://3", "t3"),
         ("e", 0, "Z", "http://4", "t4")],
        "doc string, pos bigint, folder string, url string, title string",
    )
    docs = render_documents(items_from_links(links, doc="doc"), fmt="json")
    for r in docs.collect():
        json.loads(r.text)
    nodes = flatten_json(docs.select(F.col("doc").alias("path"), F.col("text").alias("js")))
    got = sorted((r.doc, "/".join(r.folder), r.url, r.title) for r in json_links(nodes).collect())
    assert got == [("d", "Bookmarks bar", "http://3", "t3"), ("d", "Bookmarks bar/A", "http://2", "t2"),
                   ("d", "Bookmarks bar/A/B", "http://1", 't "1"'), ("e", "Bookmarks bar/Z", "http://4", "t4")]
