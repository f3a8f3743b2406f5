"""Duplicate removal inside each file.

A duplicate group is ``(file, key_url, key_title)``; the first link in
document order stays (decision D1).  Files never mix: the file is part of
every key, so one job handles any number of files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import title_key, url_key, with_keys
from ..functions.sqlfuncs import ensure_functions
from ..options import KeyOptions
from ..session import ensure_checkpoint_dir

KEY = ("key_url", "key_title")
BATCH_MODES = {"url": ("url",), "url-title": ("url-title",), "all": ("url", "url-title")}


def _first_per_group(df: DataFrame, group: Sequence[str], pos: str) -> DataFrame:
    # row_number() = 1 is planned as WindowGroupLimit: a partial limit runs
    # before the exchange, so a hot key ships at most one row per map task.
    w = Window.partitionBy(*group).orderBy(F.col(pos).asc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def dedup(links: DataFrame, opts: KeyOptions = KeyOptions(), file_col: str = "file_id", pos: str = "pos") -> DataFrame:
    """Links kept by dedup (F2): first of each duplicate group, with its keys."""
    keyed = with_keys(links, opts)
    return _first_per_group(keyed, [file_col, *KEY], pos)


def mark_duplicates(
    links: DataFrame, opts: KeyOptions = KeyOptions(), file_col: str = "file_id", pos: str = "pos"
) -> DataFrame:
    """Every link with ``kept_pos`` (position of the kept copy) and ``is_duplicate``.

    The keyed links are written once to the checkpoint folder: both branches
    read them, so links are extracted and decoded once.  The first position per group comes from a hash aggregate (map-side
    combined, so a hot key costs one row per map task), joined back on the
    key.  A key that holds a large share of rows is a skewed join partition,
    which AQE's skew-join handling splits.
    """
    ensure_checkpoint_dir(links.sparkSession)
    keyed = with_keys(links, opts).checkpoint(eager=True)
    first = keyed.groupBy(file_col, *KEY).agg(F.min(pos).alias("kept_pos"))
    return keyed.join(first, [file_col, *KEY]).withColumn("is_duplicate", F.col(pos) != F.col("kept_pos"))


def removed(links: DataFrame, opts: KeyOptions = KeyOptions(), file_col: str = "file_id", pos: str = "pos") -> DataFrame:
    """Links removed by dedup (F3), each with the position of the copy kept."""
    return mark_duplicates(links, opts, file_col, pos).where(F.col("is_duplicate")).drop("is_duplicate")


def batch_dedup(
    links: DataFrame,
    opts: KeyOptions = KeyOptions(),
    batch_mode: str = "all",
    file_col: str = "file_id",
    pos: str = "pos",
) -> DataFrame:
    """Dedup many files with one or both modes (A4-A7) in one job.

    ``batch_mode`` is ``url``, ``url-title`` or ``all`` (default).  The mode
    becomes a column and part of the key, so both modes share one shuffle.
    Every option (profile, ``-d``, strict protocol, ignore slash) applies to
    each mode.
    """
    if batch_mode not in BATCH_MODES:
        raise ValueError(f"batch_mode must be one of {sorted(BATCH_MODES)}")
    modes = BATCH_MODES[batch_mode]
    ensure_functions(links.sparkSession)
    # decoded before the modes are made: once per link
    df = links.withColumn("key_url", F.coalesce(url_key(F.col("url"), opts), F.lit("")))
    if "url-title" in modes:
        df = df.withColumn("_title", F.coalesce(title_key(F.col("title"), opts.with_mode("url-title")), F.lit("")))
    df = df.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    if "url-title" in modes:
        df = df.withColumn("key_title", F.when(F.col("mode") == "url-title", F.col("_title")).otherwise(F.lit(""))).drop("_title")
    else:
        df = df.withColumn("key_title", F.lit(""))
    return _first_per_group(df, [file_col, "mode", *KEY], pos)


def link_counts(files: DataFrame, links: DataFrame, file_col: str = "file_id") -> DataFrame:
    """Number of bookmarks per file (A8); files without links give 0."""
    counts = links.groupBy(file_col).agg(F.count(F.lit(1)).alias("n_links"))
    return files.select(file_col).join(counts, file_col, "left").select(
        file_col, F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")
    )
