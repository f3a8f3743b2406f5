"""Where converted files go and what they are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import chunk_of, rank_within, running_sum_before


def _parent(path: Column) -> Column:
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path.contains("/"), F.when(parent == "", F.lit("/")).otherwise(parent)).otherwise(F.lit("."))


def _join(dir_: Column, name: Column) -> Column:
    return F.concat(F.regexp_replace(dir_, r"/+$", ""), F.lit("/"), name)


def with_target_dir(docs: DataFrame, path: str = "path", output_dir: str | None = None) -> DataFrame:
    """``target_dir`` is ``output_dir`` (``-o``) or the input's own folder."""
    target = F.lit(output_dir) if output_dir else _parent(F.col(path))
    return docs.withColumn("target_dir", target)


def _stem(target: str) -> Column:
    return F.regexp_extract(target, r"(?s)^(.*?)(\.[^./]*)?$", 1)


def _extension(target: str) -> Column:
    return F.regexp_extract(target, r"(?s)^(.*?)(\.[^./]*)?$", 2)


def free_names(df: DataFrame, order: str, taken: DataFrame | None = None, target: str = "target_path") -> DataFrame:
    """Numbers outputs that would share a path: ``x.html``, ``x_2.html``, ``x_3.html``, ... by ``order``.

    The first of a name keeps it, unless a file of that name is there already
    (``taken``: target_path).  The others get the least numbers that no file that is
    there and no other output's own name has: with ``a/x``, ``b/x`` and ``c/x_2`` in one
    folder, ``b/x`` becomes ``x_3``.  All paths come out different.

    Places in a group come from ``rank_within`` and the numbers in use are counted
    by a chunked running sum, so that many outputs of one name do not meet in one task.
    """
    ranked = rank_within(df, [target], order, "_n")
    own = ranked.where("_n = 1").select(F.col(target).alias("_t"))
    there = (taken if taken is not None else own.limit(0).withColumnRenamed("_t", "target_path")).select(F.col("target_path").alias("_t")).distinct()
    ranked = ranked.join(there.withColumn("_there", F.lit(1)), F.col(target) == F.col("_t"), "left").drop("_t")
    # place among those of the group that need a number; 0 keeps its name
    ranked = ranked.withColumn("_r", F.col("_n") - 1 + F.coalesce("_there", F.lit(0))).drop("_n", "_there")

    number = F.regexp_extract(_stem("_t"), r"_([1-9][0-9]{0,17})$", 1)
    shorter = F.concat(F.regexp_replace(_stem("_t"), r"_[1-9][0-9]{0,17}$", ""), _extension("_t"))
    used = own.unionByName(there).distinct().where(number != "").select(shorter.alias(target), number.cast("bigint").alias("_k")).where("_k >= 2")
    used = used.join(ranked.where("_r > 0").select(target).distinct(), target, "left_semi")
    # the i-th used number k lies before every place of at least k - i: these places move on by one
    passed = rank_within(used, [target], "_k", "_i").select(target, ((F.col("_k") - F.col("_i")) * 2).alias("_o"), F.lit(1).alias("_used"))
    events = ranked.withColumn("_o", F.col("_r") * 2 + 1).unionByName(passed, allowMissingColumns=True)
    events = events.withColumn("_one", F.coalesce("_used", F.lit(0))).withColumn("_c", chunk_of("_o"))
    counted = running_sum_before(events, [target], "_o", "_c", "_one", "_before").where("_used is null")
    number = (F.col("_r") + 1 + F.col("_before")).cast("string")
    named = F.when(F.col("_r") > 0, F.concat(_stem(target), F.lit("_"), number, _extension(target))).otherwise(F.col(target))
    return counted.withColumn(target, named).drop("_r", "_o", "_used", "_one", "_c", "_before")


def stem_names(docs: DataFrame, path: str = "path", output_dir: str | None = None) -> DataFrame:
    """Output named after the input: ``x/Bookmarks`` -> ``Bookmarks.html``,
    ``x/a.json`` -> ``a.html``.  No conflict handling, like the plain converter."""
    base = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    stem = F.regexp_extract(base, r"^(.+?)(\.[^.]*)?$", 1)
    out = with_target_dir(docs, path, output_dir)
    return out.withColumn("target_path", _join(F.col("target_dir"), F.concat(stem, F.lit(".html"))))


def smart_names(
    docs: DataFrame, count: str = "n_links", path: str = "path", output_dir: str | None = None, taken: DataFrame | None = None
) -> DataFrame:
    """``bookmarks_{count}.html``; files that would share a name in one
    target folder get ``_2``, ``_3``, ... in input path order (decision D15).

    Files that are there already (``taken``) keep their names: numbers go on after them.
    """
    out = with_target_dir(docs, path, output_dir)
    name = F.concat(F.lit("bookmarks_"), F.col(count).cast("string"), F.lit(".html"))
    return free_names(out.withColumn("target_path", _join(F.col("target_dir"), name)), path, taken)
