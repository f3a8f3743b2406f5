"""Writers (S5, S6, S7).

Tables (deduplicated links, reports) go through Spark's own writers.  Named
documents -- a converted bookmark file must be called ``bookmarks_12.html``,
not ``part-00000`` -- are written by the tasks themselves through a
``pyarrow`` filesystem, so the target may be a local/NFS path or an object
store URI.

They are written in two phases.  First tasks write parts under hidden names; a
table (the manifest) lists the parts of the attempts that succeeded.  When all
tasks have ended, each file's parts are put together in order and renamed.  A job
that ends in the middle of the first phase leaves no named file; one that ends in
the second can be finished with ``finish_named``, which does what is left.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..packaging import ship
from ..session import ensure_checkpoint_dir


def write_table(df: DataFrame, out: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    """Parquet output of links or reports, optionally split by a column.

    A table without rows is written with its columns: Spark makes no file for a
    split table that is empty, and without one it can't be read again.
    """
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(out)
    if partition_by:
        spark = df.sparkSession
        if spark.read.schema(df.schema).parquet(out).isEmpty():
            spark.createDataFrame([], df.schema).write.mode("append").parquet(out)


def filesystem_of(path: str):
    """The pyarrow file system of a decoded path or URI, and the place in it."""
    if path.startswith("file:"):
        rest = path.removeprefix("file:")
        return fs.LocalFileSystem(), "/" + rest.removeprefix("//").partition("/")[2] if rest.startswith("//") else rest
    scheme, found, rest = path.partition("://")
    if not found:
        return fs.LocalFileSystem(), path
    filesystem, _ = fs.FileSystem.from_uri(f"{scheme}://{rest.partition('/')[0]}/")
    return filesystem, "/" + rest.partition("/")[2] if scheme in ("hdfs", "viewfs") else rest


_MANIFEST = "target_path string, part int, hidden string, size bigint"


def _hidden(place: str, job: str) -> str:
    folder, slash, name = place.rpartition("/")
    return f"{folder}{slash}.{name}.{job}-{uuid.uuid4().hex}"


class _Part:
    """One part of a file, under a name that no other attempt uses."""

    def __init__(self, path: str, job: str):
        self.path = path
        self.filesystem, place = filesystem_of(path)
        folder = place.rpartition("/")[0]
        if folder:
            self.filesystem.create_dir(folder, recursive=True)
        self.hidden, self.size = _hidden(place, job), 0
        self.stream = self.filesystem.open_output_stream(self.hidden)

    def write(self, text: str) -> None:
        raw = text.encode("utf-8", "surrogatepass")
        self.size += len(raw)
        self.stream.write(raw)

    def done(self, part: int) -> tuple:
        self.stream.close()
        return self.path, part, self.hidden, self.size

    def drop(self) -> None:
        self.stream.close()
        self.filesystem.delete_file(self.hidden)


def _written(rows: DataFrame, path: str, text: str, end: str, job: str) -> DataFrame:
    """Writes each run of rows of one path as a part; gives the manifest's rows.  Parts are numbered by task."""
    ship(rows.sparkSession)

    def write(batches):
        part, own = TaskContext.get().partitionId(), None
        try:
            for batch in batches:
                finished = []
                for p, t in zip(batch[path], batch[text], strict=True):
                    if own is None or p != own.path:
                        if own is not None:
                            finished.append(own.done(part))
                            own = None
                        own = _Part(p, job)
                    own.write((t or "") + end)
                if finished:
                    yield pd.DataFrame(finished, columns=["target_path", "part", "hidden", "size"])
            if own is not None:
                row, own = own.done(part), None
                yield pd.DataFrame([row], columns=["target_path", "part", "hidden", "size"])
        except BaseException:
            if own is not None:
                own.drop()
            raise

    return rows.select(path, text).mapInPandas(write, _MANIFEST)


def _put_together(batches):
    """Each file from its parts; done again after a failure, it does what is left."""
    for batch in batches:
        for path, parts in zip(batch["target_path"], batch["parts"], strict=True):
            filesystem, place = filesystem_of(path)
            hidden = [p["hidden"] for p in parts]
            there = [info.type != fs.FileType.NotFound for info in filesystem.get_file_info(hidden)]
            if all(there):
                source = hidden[0]
                if len(hidden) > 1:
                    source = _hidden(place, parts[0]["job"])
                    with filesystem.open_output_stream(source) as out:
                        for p in hidden:
                            with filesystem.open_input_stream(p) as part:
                                while raw := part.read(1 << 20):
                                    out.write(raw)
                _moved(filesystem, source, place)
                there = [len(hidden) > 1] * len(hidden)
            elif filesystem.get_file_info(place).type == fs.FileType.NotFound:
                raise FileNotFoundError(f"{path}: parts of it are gone and it was not put together")
            for p, left in zip(hidden, there, strict=True):
                if left:
                    filesystem.delete_file(p)
        yield pd.DataFrame({"target_path": batch["target_path"]})


def _moved(filesystem, source: str, place: str) -> None:
    try:
        filesystem.move(source, place)
    except OSError:  # a store that does not replace
        if filesystem.get_file_info(place).type == fs.FileType.NotFound:
            raise
        filesystem.delete_file(place)
        filesystem.move(source, place)


def _swept(batches, job: str):
    """Removes what attempts of the job that did not count have left in the folders."""
    for batch in batches:
        for folder in batch["folder"]:
            filesystem, place = filesystem_of(folder)
            for info in filesystem.get_file_info(fs.FileSelector(place or ".", allow_not_found=True)):
                if info.base_name.startswith(".") and f".{job}-" in info.base_name:
                    filesystem.delete_file(info.path)
        yield pd.DataFrame({"folder": batch["folder"]})


def _parent_of(path: str):
    return F.when(F.col(path).contains("/"), F.regexp_extract(path, r"(?s)^(.*/)[^/]*$", 1)).otherwise(F.lit("."))


def _sweep(manifest: DataFrame, job: str) -> None:
    folders = manifest.select(_parent_of("target_path").alias("folder")).distinct()
    folders.mapInPandas(lambda batches: _swept(batches, job), "folder string").count()


def finish_named(spark: SparkSession, manifest: str) -> int:
    """Puts the files of a manifest together and names them; returns their number.

    May be run again after a failure, in another session too: files that have
    their name are left alone.
    """
    ship(spark)
    parts = spark.read.parquet(manifest)
    job = F.regexp_extract("hidden", r"\.([0-9a-f]{32})-[0-9a-f]{32}$", 1)
    whole = parts.groupBy("target_path").agg(F.sort_array(F.collect_list(F.struct("part", "hidden", job.alias("job")))).alias("parts"))
    n = whole.mapInPandas(_put_together, "target_path string").count()
    if first := parts.select(job.alias("job")).first():
        _sweep(parts, first.job)
    return n


def _named(rows: DataFrame, path: str, text: str, end: str, one_row: bool) -> int:
    spark = rows.sparkSession
    job = uuid.uuid4().hex
    manifest = f"{ensure_checkpoint_dir(spark).rstrip('/')}/named-{job}"
    _written(rows, path, text, end, job).write.parquet(manifest)
    parts = spark.read.parquet(manifest)
    if one_row and (twice := parts.groupBy("target_path").count().where("count > 1").first()):
        _sweep(parts, job)
        raise ValueError(f"several documents would be written to {twice[0]}")
    return finish_named(spark, manifest)


def write_named_documents(docs: DataFrame, path: str = "target_path", text: str = "text") -> int:
    """Write each row's ``text`` to the file named by ``path``; returns the count.

    Two rows with one path are an error, found before any file has its name.  One
    document is one row, so a task holds at most its own documents.
    """
    return _named(docs, path, text, "", True)


def write_named_pieces(pieces: DataFrame, order, path: str = "target_path", text: str = "text", end: str = "", tasks: int | None = None) -> int:
    """Write documents that come as ordered pieces (rows), of any size; returns their number.

    Pieces are dealt by ranges of (path, order), so that one document's pieces
    may lie in many tasks: each writes its part, and the parts are put together
    in order.  No task holds a document.
    """
    spark = pieces.sparkSession
    keys = [F.col(path), *(F.col(c) for c in order)]
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return _named(dealt, path, text, end, False)


def write_named_lines(lines: DataFrame, path: str = "target_path", order=("k", "p"), text: str = "line") -> int:
    """Write documents that come as ordered lines (``render.render_lines``)."""
    return write_named_pieces(lines, order, path, text, end="\n")
