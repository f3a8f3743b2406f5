"""JSON files read in splits against whole documents."""

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from markhive.operators.jsonsplits import _regions, flatten_json_splits
from markhive.operators.jsontree import FIREFOX, JsonFields, flatten_json, json_errors
from markhive.operators.ordered import last_before
from markhive.plans import jobs
from markhive.sources.documents import json_targets, read_json_files

ODD = ['say "hi"', "back\\slash", "\\", '\\"', "{[,:]}", "é书😀", "", "a\nb", "x" * 90, ", {"]


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.4:
        node = {"name": rng.choice(ODD), "url": rng.choice([f"http://{rng.randrange(99)}/", 'u"\\', 5, True])}
    else:
        node = {"children": [tree(rng, depth - 1) for _ in range(rng.randrange(4))], "name": rng.choice(ODD)}
    if rng.random() < 0.5:
        node["meta_info"] = {"name": "not this", "children": [{"url": "nor this", "name": "x"}], "n": [1, [2, {"url": "no"}], "]"]}
    if rng.random() < 0.3:
        node["tags"] = [{"url": "tag", "children": []}, {"a": {}}]
    if rng.random() < 0.2:
        node = {k: None if k == "url" else v for k, v in node.items()}
    items = list(node.items())
    rng.shuffle(items)
    return dict(items)


def write_all(folder, texts):
    os.makedirs(folder, exist_ok=True)
    for name, text in texts.items():
        with open(f"{folder}/{name}.json", "w", encoding="utf-8") as f:
            f.write(text)


def in_order(nodes):
    rows = nodes.where("kind <> 'error'").collect()
    return [(r.doc, len(r.ord), tuple(r.folder), r.kind, r.name, r.url) for r in sorted(rows, key=lambda r: (r.doc, list(r.ord)))]


@pytest.mark.parametrize("size", [1, 13, 200])
def test_splits_of_any_size_give_the_whole_files_nodes(spark, tmp_dir, size):
    rng = random.Random(size)
    texts = {}
    for i in range(12):
        document = {"checksum": '"{', "roots": {r: tree(rng, 4) for r in ("bar", "other", "x")}, "version": 1}
        texts[f"t{i}"] = json.dumps(document, ensure_ascii=i % 2 == 0, indent=[None, 1, 3][i % 3])
    texts |= {"list": json.dumps({"roots": [tree(rng, 3), 5, [], tree(rng, 2)]}), "none": '{"a": 1}', "array": "[1, {}]"}
    write_all(tmp_dir, texts)
    found = json_targets(spark, f"{tmp_dir}/*.json")
    whole = in_order(flatten_json(read_json_files(spark, found)))
    assert len(whole) > 60
    assert in_order(flatten_json_splits(found.files, split=size)) == whole


def test_other_field_names(spark, tmp_dir):
    leaf = lambda k: {"title": f"t{k}", "uri": f"http://{k}"}
    write_all(tmp_dir, {"f": json.dumps({"title": "top", "children": [{"title": "menu", "children": [leaf(1), {"title": "in", "children": [leaf(2)]}]}, leaf(3)]})})
    found = json_targets(spark, f"{tmp_dir}/*.json")
    assert in_order(flatten_json_splits(found.files, FIREFOX, 9)) == in_order(flatten_json(read_json_files(spark, found), fields=FIREFOX))
    other = JsonFields(roots="children", children="children", name="title", url="uri")
    assert len(in_order(flatten_json_splits(found.files, other, 50))) == 5


def test_unreadable_files_are_error_rows(spark, tmp_dir):
    write_all(tmp_dir, {"good": '{"roots": {"b": {"name": "n", "url": "u"}}}', "cut": '{"roots": {"b": {"name": "n"', "string": '{"roots": "a', "empty": "", "text": "hello"})
    found = json_targets(spark, f"{tmp_dir}/*.json")
    errors = json_errors(flatten_json_splits(found.files, split=5)).collect()
    assert sorted(os.path.basename(r.doc) for r in errors) == ["cut.json", "empty.json", "string.json", "text.json"]


def test_conversion_by_splits(spark, tmp_dir):
    rng = random.Random(1)
    write_all(f"{tmp_dir}/in", {f"f{i}": json.dumps({"roots": {"bar": tree(rng, 4), "more": tree(rng, 3)}}) for i in range(4)})
    for reader in ("whole", "splits"):
        jobs.convert_json(spark, f"{tmp_dir}/in/*.json", output_dir=f"{tmp_dir}/{reader}", naming_rule="stem", reader=reader)
    for i in range(4):
        whole, by_splits = (open(f"{tmp_dir}/{r}/f{i}.html", encoding="utf-8").read() for r in ("whole", "splits"))
        assert whole == by_splits


def test_one_file_from_many_tasks(spark, tmp_dir):
    n = 20_000
    write_all(tmp_dir, {"big": json.dumps({"roots": {"bar": {"name": "Bar", "children": [{"name": f"F{i}", "children": [{"name": str(i), "url": f"http://{i}"}]} for i in range(n)]}}})})
    found = json_targets(spark, f"{tmp_dir}/*.json")
    links = flatten_json_splits(found.files, split=1 << 14).where("kind = 'link'")
    got = links.agg(F.count("*"), F.countDistinct("url"), F.min(F.size("folder")), F.count_if(F.get("folder", F.lit(1)) == F.concat(F.lit("F"), "name"))).first()
    assert tuple(got) == (n, n, 2, n)


def test_many_files_share_a_batch(spark, tmp_dir):
    """Regions of each file are its own, also where a file before it is unreadable."""
    texts = {f"f{i:03}": json.dumps({"roots": {"b": {"children": [{"name": f"n{i}", "url": "u" * (i % 40)}, {"name": "x", "url": "y"}]}}}) for i in range(60)}
    texts |= {f"f{i:03}": '{"roots": {"b": {"name": "n"' + ', "url": "cut' * (i % 2) for i in range(3, 60, 10)}
    write_all(tmp_dir, texts)
    found = json_targets(spark, f"{tmp_dir}/*.json")
    nodes = flatten_json_splits(found.files, split=16)
    assert len(json_errors(nodes).collect()) == 6
    assert in_order(nodes) == in_order(flatten_json(read_json_files(spark, found)))


def test_regions_of_files_come_from_one_pass():
    def split(path, start, flips, cut, change):
        return {"path": path, "start": start, "size": 20, "flips": flips, "cut0": cut, "cut1": None, "at0": 1, "at1": 0, "change0": change, "change1": 0}

    rows = [split("a", 0, 0, 5, 2), split("a", 10, 0, 14, -2), split("b", 0, 1, None, 0), split("b", 10, 0, 12, 0), split("c", 0, 0, 3, 0)]
    batches = [pd.DataFrame(rows[:1]), pd.DataFrame(rows[1:4]), pd.DataFrame(rows[4:])]
    got = [tuple(r) for out in _regions(iter(batches)) for r in out.itertuples(index=False)]
    assert got == [("a", 0, 14, 0, None), ("a", 14, 20, 3, None), ("b", 0, 20, 0, "a string does not end"), ("c", 0, 20, 0, None)]


def test_last_markers_are_not_broadcast(spark):
    """Estimates made before a run take a table derived from a short list of files for a small one."""
    rows = spark.createDataFrame([("d", 1, 0, "m"), ("d", 2, 1, None)], "doc string, pos long, chunk long, marker string")
    found = last_before(rows, ["doc"], "pos", "chunk", "marker", "anc")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.anc for r in found.orderBy("pos").collect()] == [None, "m"]
