"""Removing bookmarks from a document's own text, and writing documents that come in pieces."""

import os
import random

import pytest
from pyspark.sql import functions as F

from markhive import KeyOptions
from markhive.operators.edit import joined, link_places, pieces, without_links
from markhive.operators.extract import parse_bookmarks, tokenize
from markhive.plans import jobs
from markhive.sources import sinks
from markhive.sources.documents import read_html_files

HEAD = "<!DOCTYPE NETSCAPE-Bookmark-file-1>\r\n<!-- <DT><A HREF='ghost'>no</A> -->\n<TITLE>B</TITLE>\n<DL><p>\n"
NOTED = (
    HEAD
    + '    <DT><A HREF="http://a" ADD_DATE="1">one</A>\n    <DD>note of <b>one</b>\n  goes on\n    <HR>\n'
    + "    <DT><H3>F</H3>\n    <DD>note of F\n    <DL><p>\n"
    + '\t<DT><A HREF="http://b">two</A>\n\t<DT><A HREF="https://a/">one again</A>\r\n\t<DD>note of it\n'
    + '\t<DT><A HREF="http://b">in a row</A> <HR>\n\t<DT><A HREF="http://c">three</A>\n    </DL><p>\n</DL>'
)


def documents(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "file_id string, html string")


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def read(path):
    with open(path, encoding="utf-8", newline="") as f:
        return f.read()


def removed(spark, *rows):
    return spark.createDataFrame(rows, "file_id string, pos bigint")


def test_removed_bookmarks_go_with_their_notes_and_lines(spark):
    docs = documents(spark, d=NOTED)
    at = {r.title: r.pos for r in tokenize(docs).where("kind = 'link'").collect()}
    text = joined(without_links(docs, removed(spark, ("d", at["one again"]), ("d", at["in a row"])))).first().html
    assert text == NOTED.replace('\t<DT><A HREF="https://a/">one again</A>\r\n\t<DD>note of it\n', "").replace('<DT><A HREF="http://b">in a row</A>', "")
    text = joined(without_links(docs, removed(spark, ("d", at["one"])))).first().html
    assert text == NOTED.replace('    <DT><A HREF="http://a" ADD_DATE="1">one</A>\n    <DD>note of <b>one</b>\n  goes on\n', "")


def test_documents_come_back_as_they_are(spark):
    odd = documents(
        spark, noted=NOTED, empty="", text="no tags < at all\r\n", comment="<!-- open <A HREF=x>", line="<A HREF=a>1</A><DT><A HREF=b>2</A>", unclosed="<DT><A HREF=a>1\n<DT><A HREF=b>2"
    )
    got = {r.file_id: r.html for r in joined(without_links(odd, removed(spark))).collect()}
    assert got == {r.file_id: r.html for r in odd.collect() if r.html}


def test_every_link_is_one_piece(spark):
    from tests.test_extract import FRAGMENTS

    rng = random.Random(8)
    more = [*FRAGMENTS, "    ", "<DD>note\n", "\r\n", '<DT><A HREF="u">t</A>\n']
    rows = {str(i): "".join(rng.choice(more) for _ in range(rng.randint(1, 25))) for i in range(4000)}
    docs = documents(spark, **rows)
    parts = pieces(docs)
    whole = {r.file_id: r.html for r in joined(parts).collect()}
    assert whole == rows
    links = parts.where("link is not null").groupBy("file_id").agg(F.count("*").alias("n"), F.max("link").alias("top"))
    tokens = tokenize(docs).where("kind = 'link'").groupBy("file_id").agg(F.count("*").alias("n"))
    assert sorted((r.file_id, r.n) for r in links.collect()) == sorted((r.file_id, r.n) for r in tokens.collect())
    assert links.where("n <> top + 1").count() == 0
    places = link_places(docs).join(tokenize(docs).where("kind = 'link'"), ["file_id", "pos"])
    assert places.count() == tokens.agg(F.sum("n")).first()[0]


def test_a_long_document_is_cut_in_linear_time(spark):
    n = 50_000
    text = "<DL><p>\n" + "".join(f'    <DT><A HREF="http://a/{i % 40_000}">{i}</A>\n    <DD>n{i}\n' for i in range(n)) + "<" * n + "</DL>"
    docs = documents(spark, d=text)
    kept = parse_bookmarks(docs).links.where("title >= 0").where(F.col("title").cast("int") < 40_000)
    gone = parse_bookmarks(docs).links.where(F.col("title").cast("int") >= 40_000)
    out = joined(without_links(docs, gone))
    assert parse_bookmarks(out).links.count() == kept.count() == 40_000
    assert out.first().html.count("<DD>") == 40_000


@pytest.mark.parametrize("parser", ["regex", "html.parser"])
def test_dedup_only_removes(spark, tmp_dir, parser):
    write(f"{tmp_dir}/in/plain.html", NOTED.replace("http://b", "x:", 1).replace("https://a/", "y:"))
    write(f"{tmp_dir}/in/dups.html", NOTED)
    write(f"{tmp_dir}/in/empty.html", "")
    jobs.dedup_files(spark, f"{tmp_dir}/in", KeyOptions(ignore_slash=True), batch_mode="all", html_output_dir=f"{tmp_dir}/out", parser=parser)
    assert read(f"{tmp_dir}/out/empty.dedup-url.html") == ""
    assert read(f"{tmp_dir}/out/plain.dedup-url-title.html") == read(f"{tmp_dir}/in/plain.html")
    assert read(f"{tmp_dir}/out/plain.dedup-url.html") == read(f"{tmp_dir}/in/plain.html")
    assert read(f"{tmp_dir}/out/dups.dedup-url-title.html") == NOTED
    deduped = read(f"{tmp_dir}/out/dups.dedup-url.html")
    assert deduped == NOTED.replace('\t<DT><A HREF="https://a/">one again</A>\r\n\t<DD>note of it\n', "").replace('<DT><A HREF="http://b">in a row</A>', "")


# ------------------------------------------------------------------ the writer


def ordered(spark, folder, n=2000, name="big"):
    rows = spark.range(n).select(F.lit(f"{folder}/{name}.txt").alias("target_path"), F.col("id").alias("k"), F.concat(F.lit("line "), "id").alias("text"))
    return rows.repartition(13, F.xxhash64("k"))


def test_one_document_from_many_tasks(spark, tmp_dir):
    docs = ordered(spark, f"{tmp_dir}/o").unionByName(ordered(spark, f"{tmp_dir}/o/deep", 3, "small"))
    assert sinks.write_named_pieces(docs, ["k"], end="\n", tasks=9) == 2
    assert read(f"{tmp_dir}/o/big.txt") == "".join(f"line {i}\n" for i in range(2000))
    assert read(f"{tmp_dir}/o/deep/small.txt") == "line 0\nline 1\nline 2\n"
    assert sorted(os.listdir(f"{tmp_dir}/o")) == ["big.txt", "deep"]


def test_a_failed_job_leaves_no_named_file(spark, tmp_dir):
    docs = ordered(spark, f"{tmp_dir}/o").withColumn("text", F.when(F.col("k") == 1999, F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        sinks.write_named_pieces(docs, ["k"], end="\n", tasks=9)
    assert not os.path.exists(f"{tmp_dir}/o/big.txt")
    assert all(f.startswith(".") for f in os.listdir(f"{tmp_dir}/o")) if os.path.exists(f"{tmp_dir}/o") else True


def test_naming_can_be_finished_later(spark, tmp_dir, monkeypatch):
    manifests = []

    def killed(session, manifest):
        manifests.append(manifest)
        raise KeyboardInterrupt

    monkeypatch.setattr(sinks, "finish_named", killed)
    docs = ordered(spark, f"{tmp_dir}/o").unionByName(ordered(spark, f"{tmp_dir}/o", 5, "other"))
    with pytest.raises(KeyboardInterrupt):
        sinks.write_named_pieces(docs, ["k"], end="\n", tasks=4)
    assert all(f.startswith(".") for f in os.listdir(f"{tmp_dir}/o"))
    monkeypatch.undo()
    write(f"{tmp_dir}/o/other.txt", "from before")
    (manifest,) = manifests
    lost = f"{tmp_dir}/o/.big.txt.{manifest.rpartition('-')[2]}-{'0' * 32}"
    write(lost, "of an attempt that did not count")
    for _ in range(2):  # a second call finds nothing left to do
        assert sinks.finish_named(spark, manifest) == 2
        assert sorted(os.listdir(f"{tmp_dir}/o")) == ["big.txt", "other.txt"]
    assert read(f"{tmp_dir}/o/big.txt").count("\n") == 2000 and read(f"{tmp_dir}/o/other.txt").count("\n") == 5


def test_a_retried_task_writes_once(spark, tmp_dir):
    rows = spark.range(20).select(F.format_string(f"{tmp_dir}/o/%02d.txt", "id").alias("target_path"), F.col("id").cast("string").alias("text"))
    assert sinks.write_named_documents(rows) == 20
    assert sorted(os.listdir(f"{tmp_dir}/o")) == [f"{i:02d}.txt" for i in range(20)]
    again = rows.withColumn("text", F.lit("new"))
    assert sinks.write_named_documents(again) == 20 and read(f"{tmp_dir}/o/07.txt") == "new"


def test_written_documents_are_read_back(spark, tmp_dir):
    docs = documents(spark, **{f"{tmp_dir}/o/a b.html": NOTED, f"{tmp_dir}/o/书签.html": "", f"{tmp_dir}/o/x/c.html": "é" * 5000})
    sinks.write_named_documents(docs.withColumnRenamed("file_id", "target_path"), text="html")
    back = {r.path.removeprefix("file:"): r.html for r in read_html_files(spark, f"{tmp_dir}/o", recursive=True).collect()}
    assert back == {r.file_id: r.html for r in docs.collect()}
