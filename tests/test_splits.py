"""Files read in splits against whole files: tags, comments, scripts and values over any boundary."""

import os
import random

import pytest
from pyspark.sql import functions as F

from markhive import CompareOptions, KeyOptions
from markhive.operators import splits
from markhive.operators.extract import parse_bookmarks, tokenize
from markhive.operators.tolerant import tokenize_files
from markhive.plans import jobs
from markhive.sources.documents import html_targets, read_html_files
from tests.test_extract import FRAGMENTS, IRREGULAR, NESTED

FIELDS = ["file_id", "kind", "name", "url", "title", "attrs"]


def write_all(folder, texts):
    os.makedirs(folder, exist_ok=True)
    for name, text in texts.items():
        with open(f"{folder}/{name}.html", "w", encoding="utf-8", newline="") as f:
            f.write(text)


def in_order(tokens):
    rows = tokens.select("pos", *FIELDS).collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: (r.file_id, r.pos))]


@pytest.mark.parametrize("size", [1, 7, 64])
def test_splits_of_any_size_give_the_whole_files_tokens(spark, tmp_dir, size):
    rng = random.Random(size)
    texts = {f"r{i}": "".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 30))) for i in range(150)}
    texts |= {f"i{i}": a + b for i, (a, b) in enumerate(zip((h for h, _ in IRREGULAR.values()), reversed([h for h, _ in IRREGULAR.values()]), strict=True))}
    texts |= {"nested": NESTED, "wide": "é书签" * 20 + "<A HREF='书'>签</A>" + "😀" * 30 + "<H3>書"}
    write_all(tmp_dir, texts)
    found = html_targets(spark, tmp_dir)
    whole = in_order(tokenize(read_html_files(spark, found)))
    assert len(whole) > 200
    assert in_order(splits.tokenize_splits(found.files, size)) == whole
    assert in_order(tokenize_files(found.files.select(F.col("path").alias("file_id")), piece=size)) == whole


def test_tags_over_lines_and_splits(spark, tmp_dir):
    text = "<DL><p>\n<DT><H3\nADD_DATE='1'>My\nfolder</H3>\n<DL><p>\n" + "".join(
        f'<DT><A\n  HREF=\n"http://a/{i}"\n TITLE="{"x > y " * 40}<A HREF=ghost>"\n>t\n{i}</A\n>\n<!-- <A HREF="no">\n -->\n<script>"<A HREF=no>"</script>' for i in range(200)
    ) + "</DL><p>\n<DT><A HREF=last>open"
    write_all(tmp_dir, {"a": text})
    found = html_targets(spark, tmp_dir)
    want = sorted(tuple(r) for r in parse_bookmarks(read_html_files(spark, found)).links.select("folder", "url", "title").collect())
    assert len(want) == 201 and ([], "last", "open") in [(list(f), u, t) for f, u, t in want]
    for size in (50, 1000):
        got = splits.parse_splits(found.files, size).links
        assert sorted(tuple(r) for r in got.select("folder", "url", "title").collect()) == want
    assert sorted(tuple(r) for r in jobs.parse_files(spark, tmp_dir, reader="lines")[1].links.select("folder", "url", "title").collect()) == want
    assert sorted(tuple(r) for r in jobs.parse_files(spark, tmp_dir, parser="html.parser", reader="splits")[1].links.select("folder", "url", "title").collect()) == want


def test_one_file_is_read_by_many_tasks(spark, tmp_dir):
    lines = ["<DL><p>"]
    for f in range(30):
        lines += [f"    <DT><H3>F{f}</H3>", "    <DL><p>", f"        <DT><H3>Sub{f}</H3>", "        <DL><p>"]
        lines += [f'            <DT><A HREF="http://e.com/{f}/{i}">t{f}-{i}</A>' for i in range(20)]
        lines += ["        </DL><p>", f'        <DT><A HREF="http://e.com/{f}">t{f}</A>', "    </DL><p>"]
    write_all(tmp_dir, {"big": "\n".join([*lines, '<DT><A HREF="http://last">last</A>', "</DL><p>"]) + "\n"})
    found = html_targets(spark, tmp_dir)
    tree = splits.parse_splits(found.files, 2048)
    whole = parse_bookmarks(read_html_files(spark, found)).links
    assert sorted(tuple(r) for r in tree.links.select("folder", "url", "title").collect()) == sorted(tuple(r) for r in whole.select("folder", "url", "title").collect())
    order = [r.url for r in sorted(tree.links.collect(), key=lambda r: r.pos)]
    assert len(order) == 631 and order[0] == "http://e.com/0/0" and order[-1] == "http://last"


def test_transitions_are_those_of_each_state():
    texts = [b"a <b>", b" \"><A HREF='x>", b" --> <script>", b" </script> '>", b'x" y=\'>', b"</style><!-- >", b"<A HREF=\"u'>", b"'>"]
    rng = random.Random(4)
    texts += ["".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(1, 30))).encode() + b">" for _ in range(400)]
    for data in texts:
        quotes = (data.rfind(b'"') + 5, data.rfind(b"'") + 5)
        found = splits.Region(data, 0, quotes).transition()
        assert found == [splits.Region(data, 0, quotes).lex(s) for s in range(splits.STATES)]


def test_jobs_by_splits(spark, tmp_dir):
    write_all(tmp_dir, {"a": NESTED, "b": "<DL><DT><A HREF=http://root>again</A><DT><A HREF=http://root>twice</A></DL>", "empty": "", "text": "no tags"})
    for parser in ("regex", "html.parser"):
        kept = jobs.dedup_files(spark, tmp_dir, KeyOptions(), batch_mode="all", parser=parser, reader="splits")
        whole = jobs.dedup_files(spark, tmp_dir, KeyOptions(), batch_mode="all")
        columns = ["file_id", "mode", "url", "title", "folder"]
        assert sorted(map(tuple, kept.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))
    report = jobs.compare_files(spark, [f"{tmp_dir}/a.html", f"{tmp_dir}/b.html"], CompareOptions(), reader="splits")
    same = jobs.compare_files(spark, [f"{tmp_dir}/a.html", f"{tmp_dir}/b.html"], CompareOptions())
    assert sorted(map(str, report.drop("pos").collect())) == sorted(map(str, same.drop("pos").collect()))
    with pytest.raises(ValueError):
        jobs.parse_files(spark, tmp_dir, reader="pages")
