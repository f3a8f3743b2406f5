"""Listing of input files in tasks, level by level.

The frontier is a table of folders still to be read, each with the parts of its
pattern that are left.  One job per level lists all folders of the frontier in
its tasks (through ``pyarrow``'s file systems) and gives files that match and the
folders of the next level.  A pattern is applied part by part, so folders that
can't match are never listed.  Both tables are written to the checkpoint folder:
the driver sees counts only, however many files there are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..packaging import ship
from ..session import ensure_checkpoint_dir
from .sinks import filesystem_of

# A row of a level: a file that was found, a target that is not there, or a folder with what is left of its pattern.
_LEVEL = "kind string, path string, name string, size bigint, parts array<string>, deep boolean, exact boolean"
FILES = "path string, name string, size bigint"
_MAGIC = re.compile(r"[*?\[\]{}]")
# Folders that one task lists at least.
_FOLDERS = 64


def part_regex(part: str) -> re.Pattern[str]:
    """One part of a pattern: ``*`` and ``?`` inside a name, ``{a,b}``, ``[...]``, ``[!...]``."""
    out, i, depth = "", 0, 0
    while i < len(part):
        c = part[i]
        end = part.find("]", i + 2) if c == "[" else -1
        if end > 0:
            body = part[i + 1 : end].replace("\\", "\\\\")
            out += f"[^{body[1:]}]" if body[0] in "!^" else f"[{body}]"
            i = end
        elif c == "{":
            depth, out = depth + 1, out + "(?:"
        elif c == "}" and depth:
            depth, out = depth - 1, out + ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    return re.compile(out + ")" * depth)


def spelled_out(pattern: str) -> list[str]:
    """Patterns without braces that hold a ``/``: ``{a/b,c}/x`` is ``a/b/x`` and ``c/x``."""
    for m in re.finditer(r"\{([^{}]*)\}", pattern):
        if "/" in m[1]:
            return [p for choice in m[1].split(",") for p in spelled_out(pattern[: m.start()] + choice + pattern[m.end() :])]
    return [pattern]


def _hidden(name: str) -> bool:
    return name.startswith(("_", "."))


class _Lister:
    """Lists folders of paths such as ``file:/x`` or ``hdfs://host/x``, giving the same kind of path back."""

    def __init__(self, glob: str | None):
        self.named = part_regex(glob) if glob else None

    def entries(self, folder: str) -> Iterator[tuple[str, str, bool, int]]:
        filesystem, place = filesystem_of(folder)
        for info in filesystem.get_file_info(fs.FileSelector(place or "/", allow_not_found=True)):
            yield f"{folder.rstrip('/')}/{info.base_name}", info.base_name, info.type == fs.FileType.Directory, info.size or 0

    def look(self, path: str) -> fs.FileInfo:
        filesystem, place = filesystem_of(path)
        return filesystem.get_file_info(place or "/")

    def step(self, path: str, parts: list[str], deep: bool, exact: bool) -> Iterator[tuple]:
        """What one row of the frontier gives: rows of ``_LEVEL``.

        ``deep``: of a folder that is a target, its subfolders too.  ``exact``: the
        path itself is a target, which must be there.
        """
        name = path.rpartition("/")[2]
        if exact or (parts and not _MAGIC.search(parts[0])):
            # a name without pattern characters: looked up, not searched for
            path = path if exact else f"{path.rstrip('/')}/{parts[0]}"
            info, left = self.look(path), parts if exact else parts[1:]
            if info.type == fs.FileType.NotFound:
                if exact and not parts:
                    yield "missing", path, name, 0, [], False, False
            elif info.type == fs.FileType.Directory:
                yield "folder", path, info.base_name, 0, left, deep, False
            elif not left:
                yield "file", path, info.base_name, info.size, [], False, False
        elif not parts:
            for p, name, is_folder, size in self.entries(path):
                if is_folder and deep:
                    yield "folder", p, name, 0, [], True, False
                elif not is_folder and not _hidden(name) and (self.named is None or self.named.fullmatch(name)):
                    yield "file", p, name, size, [], False, False
        else:
            yield from self._matching(path, parts, deep)

    def _matching(self, path: str, parts: list[str], deep: bool) -> Iterator[tuple]:
        # '**' is any number of folders, none too: its other readings start in this folder as well
        readings = [parts]
        while readings[-1][:1] == ["**"] and len(readings[-1]) > 1:
            readings.append(readings[-1][1:])
        for left in readings[1:]:
            if not _MAGIC.search(left[0]):
                yield from self.step(path, left, deep, False)
        searched = [r for r in readings if _MAGIC.search(r[0])]
        for p, name, is_folder, size in self.entries(path):
            for left in searched:
                if left[0] == "**":
                    if is_folder:
                        yield "folder", p, name, 0, left, deep, False
                    elif len(left) == 1:
                        yield "file", p, name, size, [], False, False
                elif part_regex(left[0]).fullmatch(name):
                    if is_folder and (len(left) > 1 or not deep_pattern(parts)):
                        yield "folder", p, name, 0, left[1:], deep, False
                    elif not is_folder and len(left) == 1:
                        yield "file", p, name, size, [], False, False


def deep_pattern(parts: list[str]) -> bool:
    return "**" in parts


def _listed(batches, glob: str | None):
    own = _Lister(glob)
    columns = ["kind", "path", "name", "size", "parts", "deep", "exact"]
    for batch in batches:
        rows = []
        for path, parts, deep, exact in zip(batch["path"], batch["parts"], batch["deep"], batch["exact"], strict=True):
            for row in own.step(path, list(parts), deep, exact):
                rows.append(row)
                if len(rows) == 10_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def _qualified(spark: SparkSession, target: str) -> tuple[str, list[str]]:
    """A target as a full path and the parts of its pattern (none for a plain path)."""
    parts = target.split("/")
    first = next((i for i, p in enumerate(parts) if _MAGIC.search(p)), len(parts))
    base = "/".join(parts[:first]) or ("/" if target.startswith("/") else ".")
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    host = f"//{uri.getAuthority()}" if uri.getAuthority() else ""
    return f"{uri.getScheme()}:{host}{uri.getPath()}", [p for p in parts[first:] if p]


def opened_by_tasks(spark: SparkSession, targets: Iterable[str]) -> bool:
    """Whether tasks can open the targets' stores themselves."""
    try:
        for target in targets:
            filesystem_of(_qualified(spark, target)[0])[0].type_name  # noqa: B018
    except Exception:  # noqa: BLE001  a store that pyarrow does not know, or whose library is not there
        return False
    return True


def list_in_tasks(spark: SparkSession, targets: str | Iterable[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """Files of ``targets`` as a table ``(path, name, size)``, each file once.

    A target is a file (taken whatever its name), a folder (its files named by
    ``glob``, hidden ones left out; with subfolders if ``recursive``), or a pattern
    with ``*``, ``?``, ``{}``, ``[]`` or ``**`` (a folder that matches a pattern without
    ``**`` counts as a folder target).  A name that holds pattern characters and is
    there as it is written is that file.  A plain target that is not there is an
    error; a pattern may find nothing.
    """
    ship(spark)
    start = []
    for target in [targets] if isinstance(targets, str) else targets:
        path, parts = _qualified(spark, target)
        own = _Lister(None)
        if parts and own.look(f"{path.rstrip('/')}/{'/'.join(parts)}").type != fs.FileType.NotFound:
            path, parts = f"{path.rstrip('/')}/{'/'.join(parts)}", []
        if not parts:
            start.append((path, [], recursive, True))
        for pattern in spelled_out("/".join(parts)) if parts else []:
            start.append((path, pattern.split("/"), recursive, False))
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/listing-{uuid.uuid4().hex}"
    frontier = spark.createDataFrame(start, "path string, parts array<string>, deep boolean, exact boolean")
    n, levels = len(start), []
    while n:
        tasks = min(max(1, -(-n // _FOLDERS)), int(spark.conf.get("spark.sql.shuffle.partitions")))
        level = f"{folder}/{len(levels)}"
        frontier.repartition(tasks).mapInPandas(lambda batches: _listed(batches, glob), _LEVEL).write.parquet(level)
        found = spark.read.schema(_LEVEL).parquet(level)
        levels.append(found)
        if gone := found.where("kind = 'missing'").first():
            raise FileNotFoundError(gone.path)
        # a folder that two patterns or two readings of '**' lead to is listed once
        frontier = found.where("kind = 'folder'").select("path", "parts", "deep", "exact").distinct()
        n = frontier.count()
    files = levels[0] if levels else spark.createDataFrame([], _LEVEL)
    for level in levels[1:]:
        files = files.unionByName(level)
    return files.where("kind = 'file'").groupBy("path").agg(F.max("name").alias("name"), F.max("size").alias("size"))
