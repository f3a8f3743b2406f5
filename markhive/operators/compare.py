"""Comparison of bookmark files.

Keys follow decision D8: v3 decoding (``-d`` adds percent decoding), http and
https differ, trailing slashes count.  Folders are compared by full path
(decision D9).  Every report is an aggregation by key; a key's presence is
counted in two map-side-combined steps (per file, then per key), so a key
found in very many files never lands whole in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import with_keys
from ..functions.urls import has_allowed_protocol
from ..options import CompareOptions
from ..session import ensure_checkpoint_dir
from .dedup import KEY, _first_per_group

REPORT_COLUMNS = ("item_kind", "section", "file_id", "key_url", "key_title", "url", "title", "folder", "n_files")


def compare_keys(links: DataFrame, opts: CompareOptions = CompareOptions()) -> DataFrame:
    """Links after the ``-f`` filter (decision D11: before keys), with keys."""
    df = links.where(has_allowed_protocol("url")) if opts.filter else links
    return with_keys(df, opts.key_options())


def presence(links: DataFrame, opts: CompareOptions = CompareOptions(), file_col: str = "file_id") -> DataFrame:
    """In how many files each key occurs (``n_files``)."""
    pairs = compare_keys(links, opts).select(file_col, *KEY).distinct()
    return pairs.groupBy(*KEY).agg(F.count(F.lit(1)).cast("bigint").alias("n_files"))


def folders_from_paths(folders: DataFrame, file_col: str = "file_id", folder: str = "folder", sep: str = "/") -> DataFrame:
    """Every folder of each file, as full-path strings, including parents.

    ``folder`` may be a path string (``Bar/en``) or an array of names; a
    folder that only holds other folders appears through its children.
    """
    col = F.col(folder)
    parts = col if dict(folders.dtypes)[folder].startswith("array") else F.split(col, re.escape(sep))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))
    return (
        folders.where(F.size(parts) > 0)
        .select(file_col, F.explode(prefixes).alias("folder"))
        .distinct()
    )


# Folder names of a path are joined by SEP while they are keys, so that a folder
# "A/B" differs from a folder "B" in "A".  ESC keeps names apart that hold either.
SEP, ESC = "\x01", "\x02"
ITEM_KEY = ("kind", "key_url", "key_title")


def _path(links: DataFrame, folder: str, sep: str) -> Column:
    """Folder path as key text: names joined by SEP.

    A path string is split at ``sep`` (repeated, leading and trailing ones don't count).
    """
    if dict(links.dtypes)[folder].startswith("array"):
        names = F.transform(F.col(folder), lambda n: F.replace(F.replace(n, F.lit(ESC), F.lit(ESC + ESC)), F.lit(SEP), F.lit(ESC + "s")))
        return F.array_join(names, SEP)
    one = re.escape(sep)
    text = F.regexp_replace(F.regexp_replace(F.col(folder), f"{one}+", sep), f"^{one}|{one}$", "")
    return F.replace(text, F.lit(sep), F.lit(SEP))


def _shown(path: Column, sep: str) -> Column:
    text = F.replace(path, F.lit(SEP), F.lit(sep))
    back = F.replace(F.replace(F.replace(text, F.lit(ESC + ESC), F.lit(SEP)), F.lit(ESC + "s"), F.lit(SEP + "s")), F.lit(SEP), F.lit(ESC))
    return F.when(path.contains(ESC), back).otherwise(text)


def _folder_key(path: Column, opts: CompareOptions) -> Column:
    return F.substring_index(path, SEP, -1) if opts.folder_key == "name" else path


def _items(links: DataFrame, opts: CompareOptions, file_col: str, pos: str, sep: str) -> DataFrame:
    """Links with key text of their folder path and, where they take part, keys.

    ``-f`` leaves other links without keys before anything is decoded (decision
    D11).  Written once to the checkpoint folder: keys, folders and the text of
    the report all read it, and links are extracted and decoded once.
    """
    ensure_checkpoint_dir(links.sparkSession)
    path = _path(links, "folder", sep) if "folder" in links.columns else F.lit("")
    narrow = links.select(F.col(file_col).cast("string").alias("file_id"), F.col(pos).cast("bigint").alias("pos"), "url", "title", path.alias("path"))
    if opts.filter:
        narrow = narrow.withColumn("kept", has_allowed_protocol("url"))
        keyed = with_keys(narrow.where("kept"), opts.key_options())
        rest = narrow.where("not kept").withColumn("key_url", F.lit(None).cast("string")).withColumn("key_title", F.lit(None).cast("string"))
        return keyed.unionByName(rest).drop("kept").checkpoint(eager=True)
    return with_keys(narrow, opts.key_options()).checkpoint(eager=True)


def _folders(items: DataFrame, folders: DataFrame | None, opts: CompareOptions, file_col: str, pos: str, sep: str) -> DataFrame:
    """Every folder of each file: ``(file_id, key_url, path, pos)``, pos of its first item.

    With ``folders=None`` they come from the links' paths.  Paths are reduced to
    distinct ones per file before their prefixes are made: links are many,
    folders few.
    """
    if folders is not None:
        place = F.col(pos).cast("bigint") if pos in folders.columns else F.lit(0).cast("bigint")
        items = folders.select(F.col(file_col).cast("string").alias("file_id"), _path(folders, "folder", sep).alias("path"), place.alias("pos"))
    paths = items.where(F.col("path") != "").groupBy("file_id", "path").agg(F.min("pos").alias("pos"))
    if folders is None:
        prefixes = F.expr("transform(sequence(1, size(split(path, '\\u0001'))), k -> substring_index(path, '\\u0001', k))")
        paths = paths.select("file_id", F.explode(prefixes).alias("path"), "pos").groupBy("file_id", "path").agg(F.min("pos").alias("pos"))
    return paths.select("file_id", _folder_key(F.col("path"), opts).alias("key_url"), "path", "pos")


def _keys(bookmarks: DataFrame | None, folders: DataFrame | None) -> DataFrame:
    """Narrow rows of both kinds: ``(kind, key_url, key_title, file_id, pos)``."""
    parts = []
    if bookmarks is not None:
        parts.append(bookmarks.select(F.lit("bookmark").alias("kind"), "key_url", "key_title", "file_id", "pos"))
    if folders is not None:
        parts.append(folders.select(F.lit("folder").alias("kind"), "key_url", F.lit("").alias("key_title"), "file_id", "pos"))
    if not parts:
        raise ValueError("kinds must name bookmark, folder or both")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _report(found: DataFrame, bookmarks: DataFrame | None, folders: DataFrame | None, opts: CompareOptions, sep: str) -> DataFrame:
    """Joins the few keys found back to what a report shows of them.

    ``found``: ``kind, key_url, key_title, file_id, pos, section, owner, n_files``.
    """
    null = F.lit(None).cast("string")
    parts = []
    if bookmarks is not None:
        own = found.where("kind = 'bookmark'").drop("kind")
        shown = bookmarks.select("file_id", "pos", "url", "title", _shown(F.col("path"), sep).alias("folder"))
        parts.append(
            own.join(shown, ["file_id", "pos"]).select(
                F.lit("bookmark").alias("item_kind"), "section", F.col("owner").alias("file_id"), "key_url", "key_title",
                "url", "title", "folder", F.col("n_files").cast("bigint").alias("n_files"),
            )
        )
    if folders is not None:
        own = found.where("kind = 'folder'").drop("kind", "key_title")
        if opts.folder_key == "name":
            # the first path that has the name: a file has few paths
            first = folders.groupBy("file_id", "key_url", "pos").agg(F.min("path").alias("path"))
            own = own.join(first, ["file_id", "key_url", "pos"])
        else:
            own = own.withColumn("path", F.col("key_url"))
        parts.append(
            own.select(
                F.lit("folder").alias("item_kind"), "section", F.col("owner").alias("file_id"), null.alias("key_url"), null.alias("key_title"),
                null.alias("url"), null.alias("title"), _shown(F.col("path"), sep).alias("folder"), F.col("n_files").cast("bigint").alias("n_files"),
            )
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _inputs(links, folders, opts, file_col, pos, kinds, sep) -> tuple[DataFrame | None, DataFrame | None]:
    items = _items(links, opts, file_col, pos, sep)
    return (
        items.where(F.col("key_url").isNotNull()) if "bookmark" in kinds else None,
        _folders(items, folders, opts, file_col, pos, sep) if "folder" in kinds else None,
    )


def _n_files(files: DataFrame, file_col: str) -> int:
    # One number per run (the number of listed files, decision D17).
    n = files.select(file_col).distinct().count()
    if n < 2:
        raise ValueError("compare needs two or more files")
    return n


def multi_compare(
    links: DataFrame,
    folders: DataFrame | None,
    files: DataFrame,
    opts: CompareOptions = CompareOptions(),
    file_col: str = "file_id",
    pos: str = "pos",
    kinds=("bookmark", "folder"),
    sep: str = "/",
) -> DataFrame:
    """Unique (default) or intersection report for two or more files.

    ``unique``: items found in exactly one file, with that file.
    ``intersection``: items found in every listed file (an empty file makes
    it empty), shown with their first occurrence in the first file by id.

    Plan: two hash aggregations over keys and numbers only (first position per
    file and key, then files per key), both combined before their shuffles;
    text that a report shows is joined to the keys that are left.
    """
    n = _n_files(files, file_col)
    want = 1 if opts.analysis == "unique" else n
    bookmarks, folder_rows = _inputs(links, folders, opts, file_col, pos, kinds, sep)
    per_file = _keys(bookmarks, folder_rows).groupBy(*ITEM_KEY, "file_id").agg(F.min("pos").alias("pos"))
    present = per_file.groupBy(*ITEM_KEY).agg(F.count(F.lit(1)).alias("n_files")).where(F.col("n_files") == want)
    found = per_file.join(present, list(ITEM_KEY))
    if opts.analysis != "unique":
        found = _first_per_group(found, list(ITEM_KEY), "file_id")
    owner = F.col("file_id") if opts.analysis == "unique" else F.lit(None).cast("string")
    found = found.withColumn("owner", owner).withColumn("section", F.lit(opts.analysis))
    return _report(found, bookmarks, folder_rows, opts, sep)


def diff_report(
    links: DataFrame,
    folders: DataFrame | None,
    file_a: str,
    file_b: str,
    opts: CompareOptions = CompareOptions(),
    file_col: str = "file_id",
    pos: str = "pos",
    kinds=("bookmark", "folder"),
    sep: str = "/",
) -> DataFrame:
    """What A has that B lacks (``a_only``) and the reverse (``b_only``).

    One hash aggregation by key covers both directions and both kinds; each row
    shows the first occurrence of the key in the file that has it
    (decision D10).
    """
    two = links.where(F.col(file_col).isin(file_a, file_b))
    own = folders.where(F.col(file_col).isin(file_a, file_b)) if folders is not None else None
    bookmarks, folder_rows = _inputs(two, own, opts, file_col, pos, kinds, sep)
    in_a = F.col("file_id") == F.lit(file_a)
    first = _keys(bookmarks, folder_rows).groupBy(*ITEM_KEY).agg(
        F.min(F.when(in_a, F.col("pos"))).alias("a"), F.min(F.when(~in_a, F.col("pos"))).alias("b")
    )
    one = first.where(F.col("a").isNull() != F.col("b").isNull())
    is_a = F.col("a").isNotNull()
    owner = F.when(is_a, F.lit(file_a)).otherwise(F.lit(file_b))
    found = one.select(
        *ITEM_KEY, owner.alias("file_id"), F.coalesce("a", "b").alias("pos"),
        F.when(is_a, F.lit("a_only")).otherwise(F.lit("b_only")).alias("section"),
        owner.alias("owner"), F.lit(1).alias("n_files"),
    )
    return _report(found, bookmarks, folder_rows, opts, sep)


def only_in(
    links: DataFrame,
    file_a: str,
    file_b: str,
    opts: CompareOptions = CompareOptions(),
    file_col: str = "file_id",
    pos: str = "pos",
    section: str = "a_only",
) -> DataFrame:
    """Bookmarks of ``file_a`` whose key is not in ``file_b`` (anti join)."""
    two, _ = _inputs(links.where(F.col(file_col).isin(file_a, file_b)), None, opts, file_col, pos, ("bookmark",), "/")
    a = _first_per_group(two.where(F.col("file_id") == file_a), ["file_id", *KEY], "pos")
    b = two.where(F.col("file_id") == file_b).select(*KEY).distinct()
    return a.join(b, list(KEY), "left_anti").select(
        F.lit("bookmark").alias("item_kind"), F.lit(section).alias("section"), "file_id", *KEY, "url", "title", _shown(F.col("path"), "/").alias("folder"),
        F.lit(1).cast("bigint").alias("n_files"),
    )
