"""Flattening JSON bookmark files of any size, read in splits.

A split may begin inside a string, and at any depth of brackets.  So:

1. Every split is scanned for both cases, inside and outside a string: whether it
   changes the case, by how much the depth changes, and where its first comma
   outside strings is.
2. The cases and depths are composed in file order.  Regions begin at those commas,
   each at a known depth and outside strings.
3. Every region gives events: brackets that open, and the name and URL members that
   it holds, each with its byte and depth.
4. The object that a member belongs to, and all containers around an object, are the
   last ones that opened before it at their depths: one chunked window over
   ``(file, depth)`` finds them, as for HTML folders.

The nodes are those of ``jsontree.flatten_json``; ``ord`` holds bytes instead of
child numbers.  A file that does not begin like JSON or whose brackets or strings
do not close is an error row.  A single string must fit a value.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..packaging import ship
from ..session import ensure_checkpoint_dir
from .jsontree import CHROMIUM, JsonFields, _text
from .ordered import chunk_of, last_before
from .splits import CHUNK, SPLIT, _bytes, _per_row

_TOKEN = re.compile(rb'"(?:[^"\\]++|\\[\s\S])*+"|[{}\[\],:]|[^\s"{}\[\],:]++')
_ESCAPE = re.compile(rb"\\[\s\S]")
_BEGINS = re.compile(rb'\s*[{\["\-0-9tfn]')
_OPENING, _CLOSING, _COMMA, _QUOTE = b"{[", b"}]", 0x2C, 0x22
_SCAN = "path string, start bigint, size bigint, flips int, cut0 bigint, cut1 bigint, at0 bigint, at1 bigint, change0 bigint, change1 bigint"
_EVENTS = "doc string, pos bigint, depth int, key string, value string, is_object boolean, opens boolean"


def _escaped(path: str, start: int) -> bool:
    """Whether the byte at ``start`` follows an odd number of backslashes."""
    back = 64
    while start:
        before = _bytes(path, max(0, start - back), start)
        n = len(before) - len(before.rstrip(b"\\"))
        if n < len(before) or back >= start:
            return n % 2 == 1
        back *= 8
    return False


def _scanned(batches) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _SCAN.split(", ")]
    for b in batches:
        rows = []
        for path, start, end, size in zip(b["path"], b["start"], b["end"], b["size"], strict=True):
            data = _bytes(path, start, end)
            if _escaped(path, start):
                data = b"." + data[1:]
            data = np.frombuffer(_ESCAPE.sub(b"..", data), np.uint8)
            strings = np.cumsum(data == _QUOTE) & 1
            step = np.isin(data, list(_OPENING)).astype(np.int64) - np.isin(data, list(_CLOSING))
            found = []
            for inside in (0, 1):
                outside = strings == inside
                depth = np.cumsum(np.where(outside, step, 0))
                commas = np.flatnonzero(outside & (data == _COMMA))
                cut = int(commas[0]) if len(commas) else None
                found.append((None if cut is None else start + cut, 0 if cut is None else int(depth[cut]), int(depth[-1])))
            rows.append((path, start, size, int(strings[-1]), found[0][0], found[1][0], found[0][1], found[1][1], found[0][2], found[1][2]))
        yield pd.DataFrame(rows, columns=columns).astype({"cut0": "Int64", "cut1": "Int64"})


_REGIONS = "path string, start bigint, end bigint, depth int, problem string"


def _regions(batches) -> Iterator[pd.DataFrame]:
    """Regions of each file with their depths, from its splits' cases composed in order; a file's splits come together, in order."""
    columns = [c.split()[0] for c in _REGIONS.split(", ")]
    done, path, size, inside, depth, begun = [], None, 0, 0, 0, []

    def ended() -> list[tuple]:
        problem = "a string does not end" if inside else "brackets do not close" if depth else None
        ends = [*(start for start, _ in begun[1:]), size]
        return [(path, start, end, at, problem) for (start, at), end in zip(begun, ends, strict=True)]

    for b in batches:
        for row in b.itertuples(index=False):
            if row.path != path:
                if begun:
                    done += ended()
                path, size, inside, depth, begun = row.path, int(row.size), 0, 0, [(0, 0)]
            cut, at, change = ((row.cut0, row.at0, row.change0), (row.cut1, row.at1, row.change1))[inside]
            if row.start and not pd.isna(cut):
                begun.append((int(cut), depth + int(at)))
            inside, depth = inside ^ int(row.flips), depth + int(change)
            if len(done) >= 20_000:
                yield pd.DataFrame(done, columns=columns)
                done = []
    if begun:
        yield pd.DataFrame(done + ended(), columns=columns)


def _string(raw: bytes) -> str:
    try:
        return _text(json.loads(raw.decode("utf-8", "replace"), strict=False)) or ""
    except ValueError:
        return raw[1:-1].decode("utf-8", "replace")


def _events(batches, fields: JsonFields) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _EVENTS.split(", ")]
    wanted = {fields.name, fields.url}
    for b in batches:
        for path, start, end, depth in zip(b["path"], b["start"], b["end"], b["depth"], strict=True):
            data, rows, key = _bytes(path, start, end), [], None
            tokens = _TOKEN.finditer(data)
            now = next(tokens, None)
            if start == 0 and not _BEGINS.match(data):
                rows.append((path, -1, 0, "error", "it does not begin like JSON", False, False))
                now = None
            while now is not None:
                after = next(tokens, None)
                token, at = now[0], start + now.start()
                first = token[:1]
                if first in b"{[":
                    depth += 1
                    rows.append((path, at, depth, key, None, first == b"{", True))
                elif first in b"}]":
                    depth -= 1
                elif first == b'"' and after is not None and after[0] == b":":
                    key, now = _string(token), next(tokens, None)
                    continue
                elif first not in b",:" and key in wanted:
                    try:
                        value = _string(token) if first == b'"' else _text(json.loads(token))
                    except ValueError:
                        value = None
                    rows.append((path, at, depth, key, value, False, False))
                key, now = None, after
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def flatten_json_splits(files: DataFrame, fields: JsonFields = CHROMIUM, split: int = SPLIT) -> DataFrame:
    """Nodes ``(doc, ord, folder, kind, name, url)`` of ``files`` (path, size), each spread over many tasks."""
    ship(files.sparkSession)
    ensure_checkpoint_dir(files.sparkSession)
    places = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / split))
    splits = files.where("size > 0").select("path", "size", F.explode(places).alias("k"))
    splits = splits.select("path", "size", (F.col("k") * split).alias("start"), F.least((F.col("k") + 1) * split, F.col("size")).alias("end"))
    n = splits.count()
    # files are many: a task goes through all that it has been dealt, and no table of them is broadcast
    dealt = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scanned = _per_row(splits, _scanned, _SCAN, n).repartition(dealt, "path").sortWithinPartitions("path", "start")
    regions = scanned.mapInPandas(_regions, _REGIONS).checkpoint(eager=True)
    work = regions.where("problem is null and end > start").select("path", "start", "end", "depth")
    events = _per_row(work, lambda batches: _events(batches, fields), _EVENTS, n).checkpoint(eager=True)

    # every container is a marker at its depth; members ask for their object, objects for all containers around them
    ask = lambda level: F.struct(level.cast("int").alias("lvl"), F.lit(False).alias("mark"))
    d = F.col("depth")
    none = F.array().cast("array<struct<lvl:int,mark:boolean>>")
    is_node = F.col("opens") & F.col("is_object") & (d >= 3) & (d % 2 == 1)
    holds = F.col("opens") & (F.coalesce("key", F.lit("")) == fields.children) & (d >= 2)
    asked = F.when(is_node, F.transform(F.sequence(F.lit(1), F.greatest(d - 1, F.lit(1))), ask)).when(holds, F.array(ask(d - 1))).when(~F.col("opens"), F.array(ask(d))).otherwise(none)
    marked = F.when(F.col("opens"), F.array(F.struct(d.cast("int").alias("lvl"), F.lit(True).alias("mark")))).otherwise(none)
    rows = events.where("pos >= 0").select("doc", "pos", "key", "value", is_node.alias("is_node"), "opens", "is_object", F.explode(F.concat(marked, asked)).alias("r"))
    own = F.struct(F.col("pos").alias("o"), F.col("key").alias("k"), F.col("is_object").alias("obj"))
    rows = rows.select("doc", "pos", "key", "value", "is_node", "opens", F.col("r.lvl").alias("lvl"), F.col("r.mark").alias("mark"), F.when(F.col("r.mark"), own).alias("marker"), chunk_of("pos", CHUNK).alias("chunk"))
    found = last_before(rows, ["doc", "lvl"], "pos", "chunk", "marker", "anc").where("not mark").checkpoint(eager=True)

    members = found.where("not opens").select("doc", F.col("anc.o").alias("pos"), "key", "value", F.col("pos").alias("at"))
    last = lambda key: F.max_by(F.when(F.col("key") == key, F.struct("value")), F.when(F.col("key") == key, F.col("at")))["value"]
    named = members.groupBy("doc", "pos").agg(last(fields.name).alias("name"), last(fields.url).alias("url"))
    folders = found.where("opens and not is_node").select("doc", F.col("anc.o").alias("pos")).distinct().withColumn("is_folder", F.lit(True))

    first = fields.roots or fields.children
    around = found.where("is_node").select("doc", F.col("pos").alias("node"), "lvl", F.col("anc.o").alias("pos"), F.col("anc.k").alias("key"), F.col("anc.obj").alias("obj"))
    right = F.when(F.col("lvl") % 2 == 1, F.col("obj")).otherwise(F.col("key") == F.when(F.col("lvl") == 2, F.lit(first)).otherwise(F.lit(fields.children)))
    around = around.withColumn("right", F.coalesce(right, F.lit(False)))
    above = around.join(named.select("doc", "pos", "name"), ["doc", "pos"], "left")
    step = F.when((F.col("lvl") >= 3) & (F.col("lvl") % 2 == 1), F.struct("lvl", "pos", F.coalesce("name", F.lit("")).alias("name")))
    nodes = above.groupBy("doc", "node").agg(F.min("right").alias("right"), F.array_sort(F.collect_list(step)).alias("path")).where("right")
    nodes = nodes.select("doc", F.col("node").alias("pos"), "path").join(named, ["doc", "pos"], "left").join(folders, ["doc", "pos"], "left")
    kind = F.when(F.col("url").isNotNull(), "link").when(F.col("is_folder"), "folder")
    nodes = nodes.withColumn("kind", kind).where("kind is not null").select(
        "doc",
        F.concat(F.transform("path", lambda x: x["pos"]), F.array("pos")).alias("ord"),
        F.transform("path", lambda x: x["name"]).alias("folder"),
        "kind",
        F.coalesce("name", F.lit("")).alias("name"),
        "url",
    )
    bad = regions.where("problem is not null").select(F.col("path").alias("doc"), F.col("problem").alias("name")).distinct()
    bad = bad.unionByName(files.where("size = 0").select(F.col("path").alias("doc"), F.lit("it is empty").alias("name")))
    bad = bad.unionByName(events.where("pos < 0").select("doc", F.col("value").alias("name")))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return nodes.unionByName(bad.select("doc", empty("bigint").alias("ord"), empty("string").alias("folder"), F.lit("error").alias("kind"), "name", F.lit(None).cast("string").alias("url")))
