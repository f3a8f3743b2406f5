"""Readers for bookmark files (S1, S2, S3) and for crawled pages.

Every reader returns one row per document.  ``file_id`` is the file's path,
so many files are one DataFrame and one job, not a loop.

Files are listed and opened in the tasks (``frontier``), so that neither their names
nor their contents pass through the driver.  A store that only Hadoop can open is
listed on the driver and read by Spark's reader.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import decode_percent
from ..packaging import ship
from ..session import ensure_checkpoint_dir
from .frontier import list_in_tasks, opened_by_tasks
from .listing import File, list_files
from .sinks import filesystem_of

# Bytes that one task reads, and bytes of files that leave it together.
TASK_BYTES, BATCH_BYTES = 64 << 20, 8 << 20


@dataclass(frozen=True)
class Listing:
    """Listed files ``(path, name, size)``; ``on_driver`` if tasks can't open their store."""

    files: DataFrame
    on_driver: list[File] | None = None


def listing(spark: SparkSession, targets: str | Iterable[str], glob: str | None, recursive: bool) -> Listing:
    targets = [targets] if isinstance(targets, str) else list(targets)
    if opened_by_tasks(spark, targets):
        return Listing(list_in_tasks(spark, targets, glob, recursive))
    files = list_files(spark, targets, glob, recursive)
    return Listing(spark.createDataFrame([(f.path, f.name, f.size) for f in files], "path string, name string, size bigint"), files)


def _whole_files(spark: SparkSession, found: Listing) -> DataFrame:
    """One row per listed file: ``(path, text)``."""
    if found.on_driver is not None:
        return _by_spark(spark, found.on_driver)
    ship(spark)
    n, size = found.files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = min(max(1, n), max(-(-size // TASK_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    raw = found.files.select("path").repartition(tasks, "path").mapInArrow(_opened, "path string, raw binary")
    return raw.select("path", F.col("raw").cast("string").alias("text"))


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, raw = [], []
        for path in batch.column("path").to_pylist():
            filesystem, place = filesystem_of(path)
            with filesystem.open_input_stream(place) as f:
                names.append(path)
                raw.append(f.read())
            if sum(map(len, raw)) > BATCH_BYTES:
                yield pa.RecordBatch.from_pydict({"path": names, "raw": raw})
                names, raw = [], []
        if names:
            yield pa.RecordBatch.from_pydict({"path": names, "raw": raw})


def _by_spark(spark: SparkSession, files: list[File]) -> DataFrame:
    """The files by Spark's reader.  It leaves out empty ones, and names that start with ``_`` or ``.``."""
    plain = [f for f in files if f.size and not f.name.startswith(("_", "."))]
    hidden = [f for f in files if f.size and f.name.startswith(("_", "."))]
    if hidden:
        raise ValueError(f"Spark's reader can't read files whose names start with _ or .: {hidden[0].path}")
    df = spark.createDataFrame([(f.path, "") for f in files if not f.size], "path string, text string")
    if plain:
        # text() has its own wholetext argument, which wins over options
        read = spark.read.text([_escaped(f.location) for f in plain], wholetext=True)
        df = df.unionByName(read.select(decode_percent(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text")))
    return df


def _escaped(location: str) -> str:
    """A file's location for a reader that would take pattern characters as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(location))


def html_targets(spark: SparkSession, targets: str | Iterable[str], recursive: bool = False, glob: str = "*.html") -> Listing:
    """The files that ``read_html_files`` reads (S2): each once, also where targets overlap."""
    if not targets:
        raise ValueError("no targets given")
    return listing(spark, targets, glob, recursive)


def read_html_files(
    spark: SparkSession, targets: str | Iterable[str] | Listing, recursive: bool = False, glob: str = "*.html"
) -> DataFrame:
    """HTML bookmark files -> ``(file_id, path, html)``.

    ``targets`` are files, directories and patterns on any file system (S2).  A
    directory means the ``glob`` files in it, not its subdirectories unless
    ``recursive`` (decision D16).  A file named explicitly is read whatever its
    name.  Empty files are documents without text.  ``path`` is the file's URI,
    decoded.
    """
    df = _whole_files(spark, targets if isinstance(targets, Listing) else html_targets(spark, targets, recursive, glob))
    return df.select(F.col("path").alias("file_id"), "path", F.col("text").alias("html"))


def read_json_files(
    spark: SparkSession, patterns: str | Iterable[str] | Listing, recursive_name: str | None = None
) -> DataFrame:
    """JSON bookmark files -> ``(path, js)`` (S3).

    Patterns may hold ``*``, ``?``, ``{}``, ``[]`` and ``**`` (any folders), as in
    ``backups/**/Bookmarks`` or ``profiles/**/Default/Bookmarks``.  With
    ``recursive_name`` a directory means its files of that name, at any depth.
    """
    found = patterns if isinstance(patterns, Listing) else json_targets(spark, patterns, recursive_name)
    return _whole_files(spark, found).select("path", F.col("text").alias("js"))


def json_targets(spark: SparkSession, patterns: str | Iterable[str], recursive_name: str | None = None) -> Listing:
    """The files that ``read_json_files`` reads, each once."""
    return listing(spark, patterns, recursive_name, recursive_name is not None)


def existing(spark: SparkSession, folders: DataFrame, glob: str = "*.html") -> DataFrame:
    """Files that output folders (``folder``) hold already: ``(target_path)``, written as folder and name.

    The folders are listed in tasks, once: files that are written later do not count.
    """
    ship(spark)
    ensure_checkpoint_dir(spark)

    def there(batches):
        from pyarrow import fs

        suffix = glob.removeprefix("*")
        for b in batches:
            for folder in b["folder"]:
                filesystem, place = filesystem_of(folder)
                infos = filesystem.get_file_info(fs.FileSelector(place or "/", allow_not_found=True))
                names = [i.base_name for i in infos if i.type == fs.FileType.File and i.base_name.endswith(suffix) and not i.base_name.startswith((".", "_"))]
                yield pd.DataFrame({"target_path": [f"{folder.rstrip('/')}/{n}" for n in names]}, dtype=object)

    return folders.select("folder").distinct().mapInPandas(there, "target_path string").checkpoint(eager=True)


def listed(found: Listing, file_col: str = "file_id") -> DataFrame:
    """The listed files, one row each: a file without bookmarks still counts (decision D17)."""
    return found.files.select(F.col("path").alias(file_col))


def files_table(docs: DataFrame, file_col: str = "file_id") -> DataFrame:
    """The listed files, one row each.

    Kept apart from links so that a file without bookmarks still counts
    (decision D17).
    """
    return docs.select(file_col).distinct()


def pages_documents(pages: DataFrame) -> DataFrame:
    """Crawled pages as documents: ``(file_id, url, html)``, one page each."""
    return pages.select(F.col("page_id").cast("string").alias("file_id"), "url", "html")
