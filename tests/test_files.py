"""Listing, readers and writers on awkward files: empty, hidden, spaced, overlapping, repeated names."""

import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from markhive import CompareOptions, KeyOptions
from markhive.operators.extract import parse_bookmarks
from markhive.operators.jsontree import flatten_json, json_errors, json_links
from markhive.operators.ordered import rank_within
from markhive.operators.tolerant import tokenize_tolerant
from markhive.operators.extract import extract_links, links_of
from markhive.plans import jobs
from markhive.sources.documents import read_html_files, read_json_files
from markhive.sources.frontier import list_in_tasks
from markhive.sources.fixtures import fixture_documents, links_fixture
from markhive.sources.listing import glob_regex, list_files
from markhive.sources.sinks import write_named_documents
from tests.oracle import duck

SF = "/root/testdata/sf0.01"


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def doc(*links, folder="F"):
    body = "\n".join(f'<DT><A HREF="{u}">{t}</A>' for u, t in links)
    return f"<DL><p>\n<DT><H3>{folder}</H3>\n<DL><p>\n{body}\n</DL><p>\n</DL><p>\n"


def chrome(*links):
    return json.dumps({"roots": {"bar": {"type": "folder", "name": "Bar", "children": [{"type": "url", "name": t, "url": u} for u, t in links]}}})


def names(df):
    return sorted(os.path.basename(r.path) for r in df.select("path").collect())


def test_awkward_names_and_overlapping_targets(spark, tmp_dir):
    d = f"{tmp_dir}/my files"
    write(f"{d}/a b.html", doc(("http://a", "a")))
    write(f"{d}/书签.html", doc(("http://b", "b")))
    write(f"{d}/[x]{{y}}.html", doc(("http://c", "c")))
    write(f"{d}/100%25.html", doc(("http://e", "e")))
    write(f"{d}/empty.html", "")
    write(f"{d}/_hidden.html", doc(("http://d", "d")))
    plain = ["100%25.html", "[x]{y}.html", "a b.html", "empty.html", "书签.html"]
    assert names(read_html_files(spark, d)) == plain
    got = read_html_files(spark, [d, f"{d}/a b.html", f"{d}/_hidden.html", f"file://{d}/书签.html"])
    assert names(got) == sorted([*plain, "_hidden.html"])
    assert {os.path.basename(r.path): r.html == "" for r in got.collect()}["empty.html"]
    links = parse_bookmarks(got).links
    assert sorted((os.path.basename(r.file_id), r.folder[0], r.url) for r in links.collect()) == sorted(
        [("a b.html", "F", "http://a"), ("书签.html", "F", "http://b"), ("[x]{y}.html", "F", "http://c"), ("_hidden.html", "F", "http://d"), ("100%25.html", "F", "http://e")]
    )
    assert jobs.parse_files(spark, [d, f"{d}/a b.html"], reader="splits")[1].links.count() == 4
    for find in (list_files, list_in_tasks):
        with pytest.raises(FileNotFoundError):
            find(spark, f"{d}/none.html")


def test_patterns(spark, tmp_dir):
    for p in ("ud/one/Default/Bookmarks", "ud/two/x/Default/Bookmarks", "ud/Default/Bookmarks", "ud/one/Other/Bookmarks", "ud/a.json", "ud/one/b.json"):
        write(f"{tmp_dir}/{p}", chrome(("http://x", "x")))
    found = lambda p: sorted(f.path.split("/ud/")[1] for f in list_files(spark, f"{tmp_dir}/{p}"))
    assert found("ud/**/Default/Bookmarks") == ["Default/Bookmarks", "one/Default/Bookmarks", "two/x/Default/Bookmarks"]
    assert found("ud/**/*.json") == ["a.json", "one/b.json"] and found("ud/*.json") == ["a.json"]
    assert found("ud/{one,two}/**/Bookmarks") == ["one/Default/Bookmarks", "one/Other/Bookmarks", "two/x/Default/Bookmarks"]
    assert found("ud/**/nothing") == [] and found("none/**/x") == []
    assert read_json_files(spark, [f"{tmp_dir}/ud/*.json", f"{tmp_dir}/ud/a.json"]).count() == 1
    assert glob_regex("a[!b]?.x").fullmatch("acd.x") and not glob_regex("a[!b]?.x").fullmatch("abd.x")


TREE = [
    "one/Default/Bookmarks", "two/x/Default/Bookmarks", "Default/Bookmarks", "one/Other/Bookmarks", "a.json", "one/b.json", ".h/c.json",
    "_x.json", "[x]{y}.html", "a b.html", "书签.html", "100%25.html", "one/d.html", "one/_e.html", "x/x/x/f.html",
]
TARGETS = [
    ("**/Default/Bookmarks", None, False), ("**/*.json", None, False), ("*.json", None, False), ("{one,two}/**/Bookmarks", None, False),
    ("**/nothing", None, False), ("none/**/x", None, False), ("", "*.html", False), ("", "*.html", True), ("[x]{y}.html", "*.html", False),
    ("*", "*.html", False), ("o*", None, True), ("**", None, False), ("*/[!b]*.html", None, False), ("one/_e.html", "*.html", False),
    ("100%25.html", None, False), ("**/x/**/f.html", None, False), ("{one/Default,Default}/Bookmarks", None, False), ("on?/*/Book*", None, False),
]


def test_listing_in_tasks_is_the_drivers_listing(spark, tmp_dir):
    for p in TREE:
        write(f"{tmp_dir}/ud/{p}", "x" * len(p))
    some = 0
    for target, glob, recursive in TARGETS:
        want = sorted((f.path, f.name, f.size) for f in list_files(spark, f"{tmp_dir}/ud/{target}", glob, recursive))
        got = sorted(map(tuple, list_in_tasks(spark, f"{tmp_dir}/ud/{target}", glob, recursive).collect()))
        assert got == want, target
        some += len(got)
    assert some > 50
    both = list_in_tasks(spark, [f"{tmp_dir}/ud/**/*.json", f"{tmp_dir}/ud", f"file://{tmp_dir}/ud/a.json"], "*.json")
    assert both.count() == both.distinct().count() == 4


def test_listing_leaves_the_files_in_tasks(spark, tmp_dir, monkeypatch):
    for k in range(300):
        write(f"{tmp_dir}/many/{k % 30}/{k % 7}/{k}.html", "x")
    collected = []
    kind = type(spark.range(1))
    real = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: [collected.append(len(rows := real(self))), rows][1])
    files = list_in_tasks(spark, f"{tmp_dir}/many/**/*.html")
    assert max(collected, default=0) <= 1  # counts only
    assert files.count() == 300


def test_a_store_that_only_spark_opens(spark, tmp_dir, monkeypatch):
    from markhive.sources import documents

    write(f"{tmp_dir}/a b.html", doc(("http://a", "a")))
    write(f"{tmp_dir}/empty.html", "")
    by_tasks = sorted(map(tuple, read_html_files(spark, tmp_dir).collect()))
    monkeypatch.setattr(documents, "opened_by_tasks", lambda *a: False)
    assert sorted(map(tuple, read_html_files(spark, tmp_dir).collect())) == by_tasks and len(by_tasks) == 2
    with pytest.raises(ValueError):
        jobs.parse_files(spark, tmp_dir, reader="splits")


def test_empty_file_counts(spark, tmp_dir):
    write(f"{tmp_dir}/a.html", doc(("http://s", "s")))
    write(f"{tmp_dir}/b.html", doc(("http://s", "s"), ("http://b", "b")))
    write(f"{tmp_dir}/c.html", "")
    three = [f"{tmp_dir}/{x}.html" for x in "abc"]
    assert jobs.compare_files(spark, three, CompareOptions(analysis="intersection")).count() == 0
    assert jobs.compare_files(spark, three[:2], CompareOptions(analysis="intersection")).where("item_kind = 'bookmark'").count() == 1
    report = jobs.compare_files(spark, [three[0], three[2]], output=f"{tmp_dir}/report")
    assert sorted(r.folder or r.url for r in report.collect()) == ["F", "F"]
    back = spark.read.parquet(f"{tmp_dir}/report")
    assert back.select(sorted(report.columns)).exceptAll(report.select(sorted(report.columns))).count() == 0 and back.count() == 2


def test_diff_with_awkward_paths_and_slashes_in_names(spark, tmp_dir):
    write(f"{tmp_dir}/x y/甲.html", doc(("http://s", "s"), folder="A/B"))
    write(f"{tmp_dir}/x y/乙.html", "<DL><p><DT><H3>A</H3><DL><p>" + doc(("http://s", "s"), folder="B") + "</DL></DL>")
    rows = jobs.diff_files(spark, f"{tmp_dir}/x y/甲.html", f"{tmp_dir}/x y/乙.html").collect()
    assert sorted((r.section, r.folder) for r in rows if r.item_kind == "folder") == [("a_only", "A/B"), ("b_only", "A"), ("b_only", "A/B")]
    assert jobs.compare_files(spark, [f"{tmp_dir}/x y/甲.html", f"{tmp_dir}/x y/乙.html"], CompareOptions(analysis="intersection")).where("item_kind = 'folder'").count() == 0
    with pytest.raises(ValueError):
        jobs.diff_files(spark, f"{tmp_dir}/x y/甲.html", f"{tmp_dir}/x y/甲.html")


def test_filter_comes_before_decoding(spark):
    links = spark.createDataFrame([("f", 0, "A", "http://a&amp;b", "t"), ("g", 0, "A", "javascript:x", "t")], "file_id string, pos long, folder string, url string, title string")
    from markhive.operators import compare

    items = compare._items(links, CompareOptions(filter=True), "file_id", "pos", "/")
    assert {r.url: r.key_url for r in items.collect()} == {"http://a&amp;b": "http://a&b", "javascript:x": None}
    report = compare.multi_compare(links, None, links.select("file_id"), CompareOptions(filter=True))
    assert sorted((r.item_kind, r.url) for r in report.collect()) == [("bookmark", "http://a&amp;b")]


def test_outputs_are_as_many_as_inputs(spark, tmp_dir):
    write(f"{tmp_dir}/x/Bookmarks.html", doc(("http://a", "a"), ("http://a", "a")))
    write(f"{tmp_dir}/y/Bookmarks.html", doc(("http://b", "b")))
    write(f"{tmp_dir}/z/none.html", "<DL><p><DT><H3>Only</H3><DL><p></DL></DL>")
    write(f"{tmp_dir}/z/zero.html", "")
    targets = [f"{tmp_dir}/{d}" for d in "xyz"]
    kept = jobs.dedup_files(spark, targets, KeyOptions(), batch_mode="all", output=f"{tmp_dir}/kept", html_output_dir=f"{tmp_dir}/out dir")
    assert kept.count() == 4 and spark.read.parquet(f"{tmp_dir}/kept").count() == 4
    out = sorted(os.listdir(f"{tmp_dir}/out dir"))
    assert out == sorted(f"{n}.dedup-{m}{k}.html" for m in ("url", "url-title") for n, k in (("Bookmarks", ""), ("Bookmarks", "_2"), ("none", ""), ("zero", "")))
    first = open(f"{tmp_dir}/out dir/none.dedup-url.html", encoding="utf-8").read()
    assert "Only" in first
    # a second run overwrites nothing
    jobs.dedup_files(spark, targets[:1], KeyOptions(), html_output_dir=f"{tmp_dir}/out dir")
    assert sorted(set(os.listdir(f"{tmp_dir}/out dir")) - set(out)) == ["Bookmarks.dedup-url_3.html"]


@pytest.mark.parametrize("reader", ["whole", "splits"])
def test_dedup_writes_large_documents_line_by_line(spark, tmp_dir, reader):
    write(f"{tmp_dir}/a.html", doc(*[(f"http://a/{i % 300}", f"t{i}") for i in range(500)]))
    jobs.dedup_files(spark, f"{tmp_dir}/a.html", html_output_dir=f"{tmp_dir}/{reader}", reader=reader)
    text = open(f"{tmp_dir}/{reader}/a.dedup-url.html", encoding="utf-8").read()
    assert text.count("<DT><A") == 300 and text.index("http://a/7\"") < text.index("http://a/8\"")


def test_convert_numbers_conflicts_with_existing_files(spark, tmp_dir):
    write(f"{tmp_dir}/js dir/书签.json", chrome(("http://a", "a")))
    write(f"{tmp_dir}/js dir/b.json", chrome(("http://b", "b")))
    for want in (["bookmarks_1.html", "bookmarks_1_2.html"], ["bookmarks_1_3.html", "bookmarks_1_4.html"]):
        out = jobs.convert_json(spark, f"{tmp_dir}/js dir/*.json")
        assert sorted(os.path.basename(r.target_path) for r in out.select("target_path").collect()) == want
    assert sorted(os.listdir(f"{tmp_dir}/js dir")) == ["b.json", "bookmarks_1.html", "bookmarks_1_2.html", "bookmarks_1_3.html", "bookmarks_1_4.html", "书签.json"]
    write(f"{tmp_dir}/p/Bookmarks", chrome())
    write(f"{tmp_dir}/q/Bookmarks", chrome(("http://q", "q")))
    jobs.convert_json(spark, f"{tmp_dir}/[pq]/Bookmarks", output_dir=f"{tmp_dir}/o", naming_rule="stem")
    assert sorted(os.listdir(f"{tmp_dir}/o")) == ["Bookmarks.html", "Bookmarks_2.html"]


def test_converted_files_are_the_rendered_documents(spark, tmp_dir):
    tree = {"name": "A & <b>", "children": [{"name": "t", "url": "http://x?a=1&b=\"2\""}, {"name": "empty", "children": []}, {"name": "t", "children": [{"name": "t", "url": "http://y"}, {"name": "t", "url": "http://y"}]}]}
    write(f"{tmp_dir}/a.json", json.dumps({"roots": {"bar": tree, "other": tree}}))
    write(f"{tmp_dir}/none.json", chrome())
    out = jobs.convert_json(spark, f"{tmp_dir}/*.json", output_dir=f"{tmp_dir}/o").collect()
    assert sorted(r.n_links for r in out) == [0, 6]
    for r in out:
        assert open(r.target_path, encoding="utf-8").read() == r.text
    assert len(os.listdir(f"{tmp_dir}/o")) == 2


def test_unreadable_json_is_reported(spark, tmp_dir):
    write(f"{tmp_dir}/good.json", chrome(("http://a", "a")))
    write(f"{tmp_dir}/cut.json", chrome(("http://a", "a"))[:-9])
    write(f"{tmp_dir}/zero.json", "")
    errors = json_errors(flatten_json(read_json_files(spark, f"{tmp_dir}/*.json")))
    assert sorted(os.path.basename(r.doc) for r in errors.collect()) == ["cut.json", "zero.json"]
    with pytest.raises(ValueError, match="cut.json|zero.json"):
        jobs.convert_json(spark, f"{tmp_dir}/*.json")
    assert not [f for f in os.listdir(tmp_dir) if f.endswith(".html")]
    done = jobs.convert_json(spark, f"{tmp_dir}/*.json", errors="skip")
    assert [os.path.basename(r.path) for r in done.collect()] == ["good.json"]
    assert os.path.exists(f"{tmp_dir}/bookmarks_1.html")


def test_json_of_any_size_and_depth(spark, tmp_dir):
    n = 138_491
    pad = "x" * 1000
    with open(f"{tmp_dir}/big.json", "w") as f:
        f.write('{"roots":{"bar":{"name":"Bar","children":[')
        f.write(",".join(f'{{"name":"{i}","url":"http://x/{i}","pad":"{pad}"}}' for i in range(n)))
        f.write("]}}}")
    assert os.path.getsize(f"{tmp_dir}/big.json") > 135 << 20
    assert json_links(flatten_json(read_json_files(spark, f"{tmp_dir}/big.json"))).count() == n
    deep = {"name": "leaf", "url": "http://leaf"}
    for k in range(300):
        deep = {"name": f"d{k}", "children": [deep]}
    df = spark.createDataFrame([("d", json.dumps({"roots": {"r": deep}}))], "path string, js string")
    nodes = flatten_json(df)
    assert "MapInArrow" in nodes._jdf.queryExecution().executedPlan().toString() and "Exchange" not in nodes._jdf.queryExecution().executedPlan().toString()
    (link,) = json_links(nodes).collect()
    assert len(link.folder) == 300 and link.folder[0] == "d299"


def test_two_rows_for_one_file_are_an_error(spark, tmp_dir):
    df = spark.createDataFrame([(f"{tmp_dir}/x.html", "1"), (f"{tmp_dir}/x.html", "2")], "target_path string, text string")
    with pytest.raises(ValueError, match="x.html"):
        write_named_documents(df)
    assert not os.path.exists(f"{tmp_dir}/x.html")


def test_ranks_without_exchange_reuse(spark):
    old = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(300_000).select(F.lit("g").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("o"))
        got = rank_within(df, ["g"], "o", "r").agg(F.countDistinct("r"), F.min("r"), F.max("r")).first()
        assert tuple(got) == (300_000, 1, 300_000)
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)


QUOTED = """<a href="javascript:if(a>b){x()}">one</a> <A HREF='http://x/?q="a>b"'>two</A> <a title="x > y" href=http://ok>three</a>"""


def test_greater_than_in_attributes(spark):
    df = spark.createDataFrame([("d", QUOTED)], "file_id string, html string")
    want = [("javascript:if(a>b){x()}", "one"), ('http://x/?q="a>b"', "two"), ("http://ok", "three")]
    assert [(r.url, r.title) for r in extract_links(df).orderBy("pos").collect()] == want
    assert [(r.url, r.title) for r in links_of(tokenize_tolerant(df)).orderBy("pos").collect()] == want


def test_quotes_in_a_raw_href_survive_dedup(spark, tmp_dir):
    write(f"{tmp_dir}/a.html", "<DL><p>" + QUOTED + "</DL>")
    jobs.dedup_files(spark, f"{tmp_dir}/a.html", html_output_dir=f"{tmp_dir}/out")
    back = parse_bookmarks(read_html_files(spark, f"{tmp_dir}/out/a.dedup-url.html")).links
    assert sorted(r.url for r in back.collect()) == sorted(["javascript:if(a>b){x()}", 'http://x/?q="a>b"', "http://ok"])


def test_a_very_long_tag(spark):
    html = '<a icon="' + "A" * 3_000_000 + '" ' + " ".join(f'a{i}="{i}"' for i in range(20_000)) + ' href="http://x">t</a>'
    df = spark.createDataFrame([("d", html)], "file_id string, html string")
    assert [r.url for r in extract_links(df).collect()] == ["http://x"]


@pytest.mark.parametrize("fmt", ["html", "json"])
def test_fixture_written_and_read_back(spark, tmp_dir, fmt):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    docs = fixture_documents(pages, fmt).select(F.concat(F.lit(f"{tmp_dir}/in"), "path").alias("target_path"), "text")
    assert write_named_documents(docs) == pages.count()
    if fmt == "html":
        links = parse_bookmarks(read_html_files(spark, f"{tmp_dir}/in", recursive=True)).links
        folder = F.array_join("folder", "/")
    else:
        got = read_json_files(spark, [f"{tmp_dir}/in/**/Bookmarks", f"{tmp_dir}/in/**/*.json"])
        links = json_links(flatten_json(got))
        folder = F.array_join(F.slice("folder", 2, 99), "/")
    have = sorted((r.f, r.url, r.title) for r in links.select(folder.alias("f"), "url", "title").collect())
    con = duck(SF)
    want = sorted(con.execute(f"select folder, url, title from ({E.oracle_sql()['fixture_links']})").fetchall())
    assert have == want


def test_seventy_thousand_links_on_one_line(spark, tmp_dir):
    text = "<DL><p>" + "".join(f'<DT><H3>F{i}</H3><DL><p><DT><A HREF="http://a/{i}">t{i}</A></DL><p>' for i in range(70_000)) + "</DL>"
    write(f"{tmp_dir}/one.html", text)
    whole, lines = (jobs.parse_files(spark, f"{tmp_dir}/one.html", reader=r)[1].links.select("folder", "url", "title") for r in ("whole", "splits"))
    assert lines.count() == 70_000 and whole.exceptAll(lines).count() == 0


@pytest.mark.parametrize("parser", ["regex", "html.parser"])
def test_attributes_come_back_as_written(spark, tmp_dir, parser):
    text = """<DL><p><DT><H3 ADD_DATE="1" PERSONAL_TOOLBAR_FOLDER="true">Bar</H3><DL><p>
<DT><A HREF="http://a?x=1&amp;y=2" ADD_DATE="7" ICON="data:image/png;base64,AA==">a</A>
<DT><A HREF='http://b' TAGS="x > y">b</A></DL><p></DL>"""
    write(f"{tmp_dir}/a.html", text)
    jobs.dedup_files(spark, f"{tmp_dir}/a.html", html_output_dir=f"{tmp_dir}/o", parser=parser)
    back = open(f"{tmp_dir}/o/a.dedup-url.html", encoding="utf-8").read()
    for part in ('<H3 ADD_DATE="1" PERSONAL_TOOLBAR_FOLDER="true">Bar</H3>', '<A HREF="http://a?x=1&amp;y=2" ADD_DATE="7" ICON="data:image/png;base64,AA==">a</A>', """<A HREF='http://b' TAGS="x > y">b</A>"""):
        assert part in back


def test_names_are_free_of_plain_and_numbered_ones(spark, tmp_dir):
    from markhive.operators.naming import free_names

    for path in ("a/x.json", "b/x.json", "c/x_2.json"):
        write(f"{tmp_dir}/in/{path}", chrome(("http://a", path)))
    jobs.convert_json(spark, f"{tmp_dir}/in/*/*.json", output_dir=f"{tmp_dir}/o", naming_rule="stem")
    assert sorted(os.listdir(f"{tmp_dir}/o")) == ["x.html", "x_2.html", "x_3.html"]
    rng = __import__("random").Random(2)
    names = ["x", "x_2", "x_3", "x_2_2", "x_02", "y_1", "y", "x_10", "x_2_3", "z.tar"]
    rows = [(f"{i:03d}", f"/o/{rng.choice(names)}.html") for i in range(120)]
    taken = ["/o/x_3.html", "/o/x_7.html", "/o/y.html", "/o/x_4.html", "/o/w_2.html", "/o/x_3.html"]
    df = spark.createDataFrame(rows, "path string, target_path string")
    got = {r.path: r.target_path for r in free_names(df, "path", spark.createDataFrame([(t,) for t in taken], "target_path string")).collect()}
    # the rule, one by one
    used, want, place = set(taken) | {t for _, t in rows}, {}, {}
    for path, target in rows:
        if target not in place and target not in taken:
            place[target], want[path] = 1, target
            continue
        k = place.get(target, 1) + 1
        while target.replace(".html", f"_{k}.html") in used:
            k += 1
        place[target], want[path] = k, target.replace(".html", f"_{k}.html")
    assert got == want and len(set(got.values())) == len(rows)
