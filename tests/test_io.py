"""Readers (S1-S3), named-file sinks (S7), naming (S8, S9) and the jobs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from markhive import CompareOptions, KeyOptions
from markhive.operators import naming
from markhive.plans import jobs
from markhive.sources.documents import read_html_files, read_json_files
from markhive.sources.sinks import write_named_documents, write_named_lines, write_table

FILE_A = """<!DOCTYPE NETSCAPE-Bookmark-file-1>
<DL><p>
<DT><H3>Tools</H3>
<DL><p>
<DT><A HREF="http://example.com/a">A</A>
<DT><A HREF="https://example.com/a">A again</A>
<DT><A HREF="http://example.com/page/">P</A>
<DT><A HREF="http://example.com/page">P</A>
</DL><p>
<DT><H3>OnlyA</H3>
<DL><p>
</DL><p>
<DT><A HREF="http://shared">S</A>
</DL><p>
"""

FILE_B = """<DL><p>
<DT><H3>Tools</H3>
<DL><p>
<DT><A HREF="http://example.com/b">B</A>
</DL><p>
<DT><A HREF="http://shared">S</A>
</DL><p>
"""


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


@pytest.fixture
def tree(tmp_dir):
    write(f"{tmp_dir}/in/a.html", FILE_A)
    write(f"{tmp_dir}/in/b.html", FILE_B)
    write(f"{tmp_dir}/in/notes.txt", "not bookmarks")
    write(f"{tmp_dir}/in/sub/c.html", FILE_B)
    return tmp_dir


def test_read_targets(spark, tree):
    d = read_html_files(spark, [f"{tree}/in"])
    assert sorted(os.path.basename(r.path) for r in d.collect()) == ["a.html", "b.html"]
    d = read_html_files(spark, [f"{tree}/in"], recursive=True)
    assert sorted(os.path.basename(r.path) for r in d.collect()) == ["a.html", "b.html", "c.html"]
    d = read_html_files(spark, [f"{tree}/in/notes.txt", f"{tree}/in/sub"])
    assert sorted(os.path.basename(r.path) for r in d.collect()) == ["c.html", "notes.txt"]


def test_dedup_job(spark, tree):
    kept = jobs.dedup_files(spark, [f"{tree}/in/a.html"], KeyOptions(), html_output_dir=f"{tree}/out")
    assert sorted(r.url for r in kept.collect()) == ["http://example.com/a", "http://example.com/page",
                                                     "http://example.com/page/", "http://shared"]
    out = open(f"{tree}/out/a.dedup-url.html", encoding="utf-8").read()
    assert "OnlyA" in out and "A again" not in out  # folders stay, duplicates go
    assert out.index("Tools") < out.index("OnlyA") < out.index("http://shared")  # original order


def test_tolerant_parser_job(spark, tree):
    a = jobs.dedup_files(spark, [f"{tree}/in"], KeyOptions(), parser="html.parser").select("file_id", "pos")
    b = jobs.dedup_files(spark, [f"{tree}/in"], KeyOptions(), parser="regex").select("file_id", "pos")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_line_reader_jobs(spark, tree):
    a = jobs.dedup_files(spark, [f"{tree}/in"], KeyOptions(), batch_mode="all", reader="lines").select("file_id", "mode", "url")
    b = jobs.dedup_files(spark, [f"{tree}/in"], KeyOptions(), batch_mode="all").select("file_id", "mode", "url")
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
    rep = jobs.compare_files(spark, [f"{tree}/in/a.html", f"{tree}/in/b.html"], CompareOptions(), reader="lines")
    assert rep.count() == 6


def test_batch_dedup_job(spark, tree):
    kept = jobs.dedup_files(spark, [f"{tree}/in"], KeyOptions(ignore_slash=True), batch_mode="all",
                            output=f"{tree}/kept")
    per = {(os.path.basename(r.file_id), r.mode): r.n for r in kept.groupBy("file_id", "mode").agg(F.count("*").alias("n")).collect()}
    assert per == {("a.html", "url"): 3, ("a.html", "url-title"): 4, ("b.html", "url"): 2, ("b.html", "url-title"): 2}
    assert spark.read.parquet(f"{tree}/kept").count() == kept.count()


def test_compare_jobs(spark, tree):
    rep = jobs.compare_files(spark, [f"{tree}/in/a.html", f"{tree}/in/b.html"], CompareOptions())
    got = sorted((r.item_kind, os.path.basename(r.file_id), r.key_url or r.folder) for r in rep.collect())
    assert got == [
        ("bookmark", "a.html", "http://example.com/a"), ("bookmark", "a.html", "http://example.com/page"),
        ("bookmark", "a.html", "http://example.com/page/"), ("bookmark", "a.html", "https://example.com/a"),
        ("bookmark", "b.html", "http://example.com/b"), ("folder", "a.html", "OnlyA"),
    ]
    inter = jobs.compare_files(spark, [f"{tree}/in/a.html", f"{tree}/in/b.html"], CompareOptions(analysis="intersection"))
    assert sorted((r.item_kind, r.key_url or r.folder) for r in inter.collect()) == [("bookmark", "http://shared"), ("folder", "Tools")]
    diff = jobs.diff_files(spark, f"{tree}/in/a.html", f"{tree}/in/b.html")
    sides = sorted((r.section, r.item_kind, r.key_url or r.folder) for r in diff.collect())
    assert ("b_only", "bookmark", "http://example.com/b") in sides
    assert ("a_only", "folder", "OnlyA") in sides
    assert len([s for s in sides if s[0] == "a_only"]) == 5


def chromium(n_links, name="x"):
    return json.dumps({"roots": {"bookmark_bar": {"type": "folder", "name": "Bar", "children": [
        {"type": "url", "name": f"{name}{i}", "url": f"http://{name}/{i}"} for i in range(n_links)]}}})


def test_convert_json_smart_names(spark, tmp_dir):
    write(f"{tmp_dir}/backups/one/Bookmarks", chromium(2, "a"))
    write(f"{tmp_dir}/backups/two/Bookmarks", chromium(2, "b"))  # same count: conflict
    write(f"{tmp_dir}/backups/two/deeper/Bookmarks", chromium(3, "c"))
    write(f"{tmp_dir}/exports/x.json", chromium(1, "d"))
    out = jobs.convert_json(spark, [f"{tmp_dir}/backups/**/Bookmarks", f"{tmp_dir}/exports/*.json"],
                            output_dir=f"{tmp_dir}/html")
    names = sorted(os.listdir(f"{tmp_dir}/html"))
    assert names == ["bookmarks_1.html", "bookmarks_2.html", "bookmarks_2_2.html", "bookmarks_3.html"]
    first = [r for r in out.collect() if r.target_path.endswith("bookmarks_2.html")][0]
    assert "/backups/one/" in first.path  # conflicts numbered in input path order
    text = open(f"{tmp_dir}/html/bookmarks_3.html", encoding="utf-8").read()
    assert text.count("<DT><A HREF=") == 3


def test_convert_json_stem_names_next_to_input(spark, tmp_dir):
    write(f"{tmp_dir}/exports/x.json", chromium(1, "d"))
    write(f"{tmp_dir}/backups/p/Bookmarks", chromium(2, "e"))
    jobs.convert_json(spark, [f"{tmp_dir}/exports/*.json", f"{tmp_dir}/backups/**/Bookmarks"], naming_rule="stem")
    assert os.path.exists(f"{tmp_dir}/exports/x.html")
    assert os.path.exists(f"{tmp_dir}/backups/p/Bookmarks.html")


def test_naming_rules(spark):
    df = spark.createDataFrame(
        [("/a/x/Bookmarks", 3), ("/a/y/Bookmarks", 3), ("/a/x/b.json", 3), ("/a/x/c.json", 1), ("rel.json", 0)],
        "path string, n_links bigint",
    )
    smart = {r.path: r.target_path for r in naming.smart_names(df).collect()}
    assert smart["/a/x/Bookmarks"] == "/a/x/bookmarks_3.html"
    assert smart["/a/x/b.json"] == "/a/x/bookmarks_3_2.html"
    assert smart["/a/y/Bookmarks"] == "/a/y/bookmarks_3.html"
    assert smart["rel.json"] == "./bookmarks_0.html"
    with_o = {r.path: r.target_path for r in naming.smart_names(df, output_dir="/o").collect()}
    assert sorted(with_o.values()) == ["/o/bookmarks_0.html", "/o/bookmarks_1.html", "/o/bookmarks_3.html",
                                       "/o/bookmarks_3_2.html", "/o/bookmarks_3_3.html"]
    assert with_o["/a/x/Bookmarks"] == "/o/bookmarks_3.html"  # first by path
    stem = {r.path: r.target_path for r in naming.stem_names(df).collect()}
    assert stem["/a/x/Bookmarks"] == "/a/x/Bookmarks.html" and stem["/a/x/b.json"] == "/a/x/b.html"


def test_named_lines_sink(spark, tmp_dir):
    from markhive.operators.render import items_from_links, render_lines

    links = spark.createDataFrame(
        [("d1", 0, "A", "http://1", "one"), ("d1", 1, "A/B", "http://2", "two"), ("d2", 0, "", "http://3", "three")],
        "doc string, pos bigint, folder string, url string, title string",
    )
    lines = render_lines(items_from_links(links, doc="doc")).withColumn(
        "target_path", F.concat(F.lit(f"{tmp_dir}/lines/"), F.col("doc"), F.lit(".html"))
    )
    write_named_lines(lines)
    docs = read_html_files(spark, [f"{tmp_dir}/lines"])
    from markhive.operators.extract import parse_bookmarks

    got = sorted((os.path.basename(r.file_id), "/".join(r.folder), r.url) for r in parse_bookmarks(docs).links.collect())
    assert got == [("d1.html", "A", "http://1"), ("d1.html", "A/B", "http://2"), ("d2.html", "", "http://3")]


def test_named_documents_sink(spark, tmp_dir):
    df = spark.createDataFrame([(f"{tmp_dir}/n/a/x.html", "X"), (f"{tmp_dir}/n/b/y.html", "Y")], "target_path string, text string")
    assert write_named_documents(df) == 2
    assert open(f"{tmp_dir}/n/b/y.html").read() == "Y"


def test_read_json_glob(spark, tmp_dir):
    write(f"{tmp_dir}/j/a.json", "{}")
    write(f"{tmp_dir}/j/deep/er/Bookmarks", "{}")
    assert read_json_files(spark, f"{tmp_dir}/j/*.json").count() == 1
    assert read_json_files(spark, f"{tmp_dir}/j/**/Bookmarks").count() == 1


def test_a_report_without_rows_is_read_back(spark, tree):
    out = f"{tree}/report"
    with open(f"{tree}/in/b.html", "w", encoding="utf-8") as f:
        f.write(FILE_A)
    files = [f"{tree}/in/a.html", f"{tree}/in/b.html"]
    report = jobs.compare_files(spark, files, CompareOptions(), output=out)
    back = spark.read.parquet(out)
    assert back.count() == 0 and dict(back.dtypes) == dict(report.dtypes)
    # rows that are added later, or written in its place, are read as ever
    row = spark.createDataFrame([("bookmark", "unique")], "item_kind string, section string")
    for mode in ("append", "overwrite"):
        write_table(row, out, partition_by="item_kind", mode=mode)
        assert [(r.item_kind, r.section) for r in spark.read.parquet(out).collect()] == [("bookmark", "unique")]
