"""Exact token counts for every context limit, from a histogram of lengths.

Documents are aggregated by their encoded length (partial sums in the tasks, so
a length that many documents share is no burden).  Everything else comes from
sums over the histogram's suffixes: how many documents are longer than a limit,
how many tokens are left when texts are cut there, and quantiles.  The sums run
inside chunks of lengths plus the sums of the chunks around them, so that no
task holds the whole histogram.

Between two lengths of the histogram the truncated total is linear, so ``at``
answers any limit exactly.

Cases: null and empty texts have 0 tokens; an empty table gives no rows;
repeated rows count each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markhive.llm.common import stored
from markhive.llm.piece_codec import lengths

#: Lengths of a chunk.
CHUNK = 1024


def histogram(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length."""
    return lengths(df.select(F.col(f"`{text}`").alias("text")), model_path).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limits(counts: DataFrame) -> DataFrame:
    """For every length L of the histogram, as a context limit:

    n_docs of that length, docs_over (longer ones), docs_share (share of documents
    of at most L), full_tokens (tokens of documents of at most L), truncated_tokens
    (all tokens when texts are cut at L), total_tokens.
    """
    # small, and read twice below: texts are encoded once
    df = stored(counts, "token-histogram").withColumn("chunk", F.floor(F.col("n_tokens") / CHUNK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    inside = Window.partitionBy("chunk").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("docs_in", F.sum("n_docs").over(inside)).withColumn("tokens_in", F.sum("tokens").over(inside))
    sums = df.groupBy("chunk").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("tokens"))
    ahead = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    sums = sums.select(
        "chunk",
        F.coalesce(F.sum("docs").over(ahead), zero).alias("docs_ahead"),
        F.coalesce(F.sum("tokens").over(ahead), zero).alias("tokens_ahead"),
        F.sum("docs").over(whole).alias("all_docs"),
        F.sum("tokens").over(whole).alias("total_tokens"),
    )
    df = df.join(sums, "chunk")
    upto = F.col("docs_ahead") + F.col("docs_in")
    full = F.col("tokens_ahead") + F.col("tokens_in")
    over = F.col("all_docs") - upto
    return df.select(
        "n_tokens",
        "n_docs",
        over.alias("docs_over"),
        (upto / F.col("all_docs")).alias("docs_share"),
        full.alias("full_tokens"),
        (full + F.col("n_tokens") * over).alias("truncated_tokens"),
        "total_tokens",
    )


def at(table: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit: docs_over, truncated_tokens, total_tokens (``table`` from limits())."""
    below = table.where(F.col("n_tokens") <= limit).agg(F.max_by(F.struct("n_tokens", "docs_over", "truncated_tokens"), "n_tokens").alias("b"))
    whole = table.agg(F.max("total_tokens").alias("total_tokens"), F.max(F.col("n_docs") + F.col("docs_over")).alias("docs"))
    row = below.withColumn("one", F.lit(1)).join(whole.withColumn("one", F.lit(1)), "one")
    over = F.coalesce("b.docs_over", "docs")
    cut = F.coalesce(F.col("b.truncated_tokens") + (F.lit(limit) - F.col("b.n_tokens")) * F.col("b.docs_over"), F.lit(limit) * F.col("docs"))
    return row.select(F.lit(limit).alias("context"), over.alias("docs_over"), cut.alias("truncated_tokens"), "total_tokens")


def quantile(table: DataFrame, share: float) -> DataFrame:
    """One row: the smallest length that at least ``share`` of the documents don't exceed."""
    return table.where(F.col("docs_share") >= share).agg(F.min("n_tokens").alias("n_tokens"))
