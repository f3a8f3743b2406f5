"""Flattening JSON bookmark trees.

Each JSON file is one row.  Its tree is walked inside the task that read it
(``mapInArrow``): one narrow stage, no shuffle, and a number of jobs that does
not depend on the nesting.  While a document is parsed, every object that is a
link or folder shrinks to its name, URL and children.  Nodes leave in slices,
so a task holds one parsed document at a time, of any size that fits a row.

Field names are parameters (decision D14): Chromium files use
``roots``/``children``/``name``/``url``, Firefox backups
``children``/``title``/``uri`` with the document itself as root.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..packaging import ship
from .render import elem

_FIELD = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
# Nodes handed over at a time.
_SLICE = 20_000


@dataclass(frozen=True)
class JsonFields:
    roots: str | None = "roots"  # object of root folders; None: the document's children are the roots
    children: str = "children"
    name: str = "name"
    url: str = "url"

    def __post_init__(self):
        for f in (self.roots, self.children, self.name, self.url):
            if f is not None and not _FIELD.match(f):
                raise ValueError(f"unsupported field name {f!r}")


CHROMIUM = JsonFields()
FIREFOX = JsonFields(roots=None, children="children", name="title", url="uri")


class _Node:
    """What is kept of a JSON object that is a link or a folder."""

    __slots__ = ("children", "name", "url")

    def __init__(self, name: str, url: str | None, children: list | None):
        self.name, self.url, self.children = name, url, children


def _text(value) -> str | None:
    """A string, or the JSON text of a number or boolean."""
    if isinstance(value, str):
        try:
            value.encode("utf-8")
        except UnicodeEncodeError:  # a lone surrogate escape
            return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        return value
    return json.dumps(value) if isinstance(value, (bool, int, float)) else None


def _members(value) -> list | None:
    if isinstance(value, dict):
        return list(value.values())
    return value if isinstance(value, list) else None


def parse_tree(text: str, fields: JsonFields = CHROMIUM) -> list:
    """Top-level nodes of one document; raises ``ValueError`` if it can't be read."""

    def shrink(o: dict):
        url, children = _text(o.get(fields.url)), _members(o.get(fields.children))
        if url is None and children is None:
            return o
        return _Node(_text(o.get(fields.name)) or "", url, children)

    try:
        top = json.loads(text, object_hook=shrink)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    if fields.roots:
        found = _members(top.get(fields.roots)) if isinstance(top, dict) else None
    else:
        found = top.children if isinstance(top, _Node) else None
    return found or []


def walk(top: list) -> Iterator[tuple[list[int], list[str], str, str, str | None]]:
    """``(ord, folder, kind, name, url)`` of all nodes in document order."""
    stack = [(iter(enumerate(top)), [], [])]
    while stack:
        members, place, folder = stack[-1]
        step = next(members, None)
        if step is None:
            stack.pop()
            continue
        i, node = step
        if not isinstance(node, _Node):
            continue
        here = [*place, i]
        yield here, folder, "link" if node.url is not None else "folder", node.name, node.url
        if node.children:
            stack.append((iter(enumerate(node.children)), here, [*folder, node.name]))


_COLUMNS = ("ord", "folder", "kind", "name", "url")
_TYPES = (pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.string(), pa.string())


def _flatten(batches: Iterable[pa.RecordBatch], fields: JsonFields, keep_errors: bool) -> Iterator[pa.RecordBatch]:
    def batch_of(doc: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        docs = pa.concat_arrays([doc] * len(rows)) if len(rows) < 2 else doc.take(pa.array([0] * len(rows)))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
        return pa.RecordBatch.from_arrays([docs, *columns], names=["doc", *_COLUMNS])

    for batch in batches:
        for i in range(batch.num_rows):
            doc, text = batch.column(0).slice(i, 1), batch.column(1)[i].as_py()
            try:
                top = parse_tree(text if text is not None else "", fields)
            except ValueError as e:
                if not keep_errors:
                    raise ValueError(f"not a readable JSON bookmark file: {doc[0].as_py()}: {e}") from e
                yield batch_of(doc, [([], [], "error", str(e), None)])
                continue
            rows: list[tuple] = []
            for node in walk(top):
                rows.append(node)
                if len(rows) == _SLICE:
                    yield batch_of(doc, rows)
                    rows = []
            if rows:
                yield batch_of(doc, rows)


def flatten_json(
    docs: DataFrame, doc: str = "path", js: str = "js", fields: JsonFields = CHROMIUM, errors: str = "keep"
) -> DataFrame:
    """Nodes of every tree: ``(doc, ord, folder, kind, name, url)``.

    ``ord`` is the node's position path (child index per level) and sorts in
    document order; ``folder`` the names of its ancestors, roots included.
    ``kind`` is ``link`` for nodes with a URL and ``folder`` for nodes with
    children; other nodes (separators) are dropped.  A document that is not
    readable JSON (cut off, empty, null) gives one row of kind ``error`` whose
    name tells why (``json_errors``); ``errors="raise"`` fails the job with its path.
    """
    if errors not in ("raise", "keep"):
        raise ValueError("errors must be raise or keep")
    ship(docs.sparkSession)
    kind = docs.select(F.col(doc).alias("doc")).schema["doc"].dataType.simpleString()

    def run(batches):
        return _flatten(batches, fields, errors == "keep")

    schema = f"doc {kind}, ord array<int>, folder array<string>, kind string, name string, url string"
    return docs.select(F.col(doc).alias("doc"), F.col(js)).mapInArrow(run, schema)


def json_errors(nodes: DataFrame) -> DataFrame:
    """Documents that could not be read: ``(doc, message)``."""
    return nodes.where(F.col("kind") == "error").select("doc", F.col("name").alias("message"))


def json_links(nodes: DataFrame) -> DataFrame:
    """Links of flattened trees: ``(doc, ord, folder, url, title)``."""
    return nodes.where(F.col("kind") == "link").select("doc", "ord", "folder", "url", F.col("name").alias("title"))


def json_folders(nodes: DataFrame) -> DataFrame:
    """Folders of flattened trees with their full path (own name included)."""
    return nodes.where(F.col("kind") == "folder").select(
        "doc", "ord", F.concat("folder", F.array("name")).alias("folder")
    )


def items_from_json(nodes: DataFrame) -> DataFrame:
    """Tree items for ``render`` in the JSON document order."""
    path = F.transform(
        F.sequence(F.lit(1), F.size("folder")),
        lambda i: elem(1, F.element_at("ord", i), F.element_at("folder", i)),
    )
    path = F.when(F.size("folder") > 0, path).otherwise(F.array().cast("array<struct<t:int,o:bigint,n:string>>"))
    return nodes.where(F.col("kind").isin("link", "folder")).select(
        "doc",
        "kind",
        path.alias("path"),
        elem(1, F.element_at("ord", -1), F.when(F.col("kind") == "folder", F.col("name")).otherwise(F.lit(""))).alias("elem"),
        F.lit(0).cast("bigint").alias("pos"),
        "name",
        "url",
        F.col("name").alias("title"),
    )
