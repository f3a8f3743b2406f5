"""Running values over document order that stay spread over many tasks.

A window ``partitionBy(doc).orderBy(pos)`` puts a whole document in one task.
If one document holds a large share of all rows, that task holds it all.
The helpers here split each partition into chunks that are contiguous in
order, compute the running value inside each chunk with a window, and add the
carry from earlier chunks, taken from a small table with one row per chunk.
The small table is joined back: sums by a join that AQE broadcasts when its
measured size is small, last markers always by a shuffle join, on keys that the
window is dealt by already.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Rows per chunk of one document.  Normal bookmark files (tens of thousands
# of links) are a single chunk.
DEFAULT_CHUNK_ROWS = 1 << 20


def chunk_of(pos: Column | str, rows: int = DEFAULT_CHUNK_ROWS) -> Column:
    p = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(p / F.lit(rows)).cast("bigint")


def running_sum_before(
    df: DataFrame, part: Sequence[str], order: str, chunk: str, value: str, out: str
) -> DataFrame:
    """``out`` = sum of ``value`` over earlier rows of the same ``part``."""
    part = list(part)
    w_local = Window.partitionBy(*part, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    w_whole = Window.partitionBy(*part, chunk)
    local = df.withColumn("_rs_local", F.coalesce(F.sum(value).over(w_local), F.lit(0))).withColumn(
        "_rs_chunk", F.sum(value).over(w_whole)
    )
    # The chunk total is read from the window's own output, so the optimizer
    # keeps this aggregate on top of the same window: both branches share one
    # exchange (reused) and the input is computed once.
    totals = local.groupBy(*part, chunk).agg(F.max("_rs_chunk").alias("_rs_total"))
    w_chunks = Window.partitionBy(*part).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *part, chunk, F.coalesce(F.sum("_rs_total").over(w_chunks), F.lit(0)).alias("_rs_base")
    )
    return (
        local.join(base, [*part, chunk])
        .withColumn(out, (F.col("_rs_base") + F.col("_rs_local")).cast("bigint"))
        .drop("_rs_base", "_rs_local", "_rs_chunk")
    )


def last_before(
    df: DataFrame, part: Sequence[str], order: str, chunk: str, marker: str, out: str
) -> DataFrame:
    """``out`` = the last non-null ``marker`` on an earlier row of the same ``part``."""
    part = list(part)
    w_local = Window.partitionBy(*part, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    w_whole = Window.partitionBy(*part, chunk).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    local = df.withColumn("_lb_local", F.last(marker, ignorenulls=True).over(w_local)).withColumn(
        "_lb_chunk", F.last(marker, ignorenulls=True).over(w_whole)
    )
    # As in running_sum_before: read the chunk's last marker from the window
    # output so both branches share the window's exchange.
    last_in_chunk = local.groupBy(*part, chunk).agg(F.first("_lb_chunk", ignorenulls=True).alias("_lb_last"))
    w_chunks = Window.partitionBy(*part).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = last_in_chunk.select(
        *part, chunk, F.last("_lb_last", ignorenulls=True).over(w_chunks).alias("_lb_carry")
    )
    # One row per part and chunk: with many parts that is a large table, which the
    # estimates made before the run may take for a small one.
    return (
        local.join(carry.hint("merge"), [*part, chunk])
        .withColumn(out, F.coalesce("_lb_local", "_lb_carry"))
        .drop("_lb_local", "_lb_carry", "_lb_chunk")
    )


def rank_within(df: DataFrame, group: Sequence[str], order: str, out: str, chunks: int | None = None) -> DataFrame:
    """``out`` = 1-based place of each row in its ``group`` ordered by ``order``.

    Like ``row_number()`` over ``partitionBy(group)``, but a large group is
    split: rows are range-partitioned on ``(group, order)``, each task numbers
    its share, and earlier tasks' counts are added from the per-chunk table.
    ``order`` must be unique within a group.  The ranged rows are checkpointed:
    numbering and counting read the same rows, whatever the optimizer reuses.
    """
    group = list(group)
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(n, *[F.col(g) for g in group], F.col(order))
        .withColumn("_rk_chunk", F.spark_partition_id().cast("bigint"))
        .withColumn("_rk_one", F.lit(1))
    )
    ensure_checkpoint_dir(df.sparkSession)
    ranged = ranged.checkpoint(eager=True)
    ranked = running_sum_before(ranged, group, order, "_rk_chunk", "_rk_one", out)
    return ranked.withColumn(out, F.col(out) + 1).drop("_rk_chunk", "_rk_one")
