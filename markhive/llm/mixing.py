"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents are shuffled by a hash and laid end to end; the line,
repeated as often as a source may be used, is cut into blocks of equal words.
A van der Corput / golden-ratio sequence of points in [0, 1) goes through the
cumulated targets: slot i belongs to the source whose interval holds point i,
and the slot's rank among its source's slots is the block that it takes.  So
every stretch of the mix holds each source in about its share.  Blocks that no
point has reached when the points end get slots after the last one: a source
gets all its blocks, however few they are beside the others'.

Targets (``targets``): each source's share of the total by weight, at most
``max_repeats`` times its size; what is over goes to the others by weight until
none is above its limit.  All steps are DataFrame operations on narrow rows.
Ranks and running sums are taken in chunks (inside a chunk, plus the sums of the
chunks before), so that a source that holds a third of all rows spreads over
many tasks.  Points meet sources by equality on a grid over [0, 1).

Cases: a null source is a source of its own and comes last; a null text has
size 0; documents of size 0 are never taken; repeated rows are documents of
their own; an empty table gives an empty result; a total of 0 gives targets 0.
A very long text is a document over many blocks.  Other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markhive.llm.common import partitions_of, stored
from markhive.llm.vectors import free_name

#: Words of a block.
BLOCK_WORDS = 2048
#: Documents in a chunk of a source's line, and slots in a chunk of the schedule (about).
CHUNK_ROWS = 4096
#: Cells of the grid on which points meet sources.
GRID = 4096
#: Weights of the sources in their order, over and over.
WEIGHTS = (5, 2, 1)
#: Numerator of the golden-ratio step over 2^42 (odd, so that all 2^42 points come once).  No quotient of its
#: continued fraction is over 3, so that points are even at any number of slots.
GOLDEN = 2718142222549
PERIOD = 1 << 42
#: Slots are multiplied in two parts of 21 bits, so that products stay below 2^63.
HALF = 1 << 21


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """source, source_size, target of each source; ``sizes`` has source and size.

    Water filling: sources in order of the level at which they reach their
    limit; with the first k of them at their limits, the rest share what is left
    by weight at one level.  The level is right at the first k whose next source
    lies at or above it.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(in_order) - 1) % len(weights) + 1)
    limits = sums.withColumn("weight", by_weight.cast("double")).withColumn("limit", max_repeats * F.col("source_size").cast("double"))
    limits = limits.withColumn("level", F.col("limit") / F.col("weight"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = limits.withColumns(
        {
            "full": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
            "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "total": F.sum("source_size").over(whole) * share,
            "weights": F.sum("weight").over(whole),
        }
    )
    at = at.withColumn("try", (F.col("total") - F.col("full")) / (F.col("weights") - F.col("gone")))
    # sources whose level lies below the common one get their limit
    at = at.withColumn("common", F.max(F.when(F.col("try") <= F.col("level"), F.col("try"))).over(whole))
    target = F.when(F.col("common").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("common") * F.col("weight")))
    return at.select("source", "source_size", "n_docs", F.coalesce(target, F.lit(0.0)).alias("target"))


def _running(df: DataFrame, key: str, chunk: str, order: list[Column], value: Column, to: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before, in (chunk, order), within the key."""
    inside = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(to, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    sums = df.groupBy(key, chunk).agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("_key"), F.col(chunk).alias("_chunk"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    joined = df.join(sums, (F.col(key) == F.col("_key")) & (F.col(chunk) == F.col("_chunk")))
    return joined.withColumn(to, F.col(to) + F.col("_ahead")).drop("_key", "_chunk", "_ahead")


def lines(sizes: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """Each document's place in its source's shuffled line: ``start``, in words."""
    n_chunks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / CHUNK_ROWS))
    hashed = sizes.join(wanted, sizes["source"].eqNullSafe(wanted["source"])).drop(wanted["source"])
    hashed = hashed.withColumn("shuffle", F.xxhash64(F.lit(seed), "doc_id"))
    # the chunk is the high part of the hash: chunks in order are the line in order
    unit = F.col("shuffle") / F.lit(2.0**64) + 0.5
    hashed = hashed.withColumn("chunk", F.least(F.floor(unit * n_chunks), n_chunks - 1).cast("long"))
    hashed = hashed.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    return _running(hashed, "source_key", "chunk", [F.col(c) for c in ("shuffle", "doc_id", "size", "row")], F.col("size"), "start")


def schedule(wanted: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, source_key, rank: the source of each slot and how many of its slots came before.

    The points go on for an eighth over the total, and for some slots more by
    source.  Blocks that none of them reached follow in slots of their own.
    """
    spark = wanted.sparkSession
    keyed = wanted.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    whole = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # a source's interval follows its blocks: its target in whole blocks
    keyed = keyed.withColumn("blocks", F.ceil(F.col("target") / block_words))
    keyed = keyed.withColumn("all_blocks", F.sum("blocks").over(whole))
    upto = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, 0)
    keyed = keyed.withColumn("high", F.try_divide(F.sum("blocks").over(upto), F.col("all_blocks")))
    keyed = keyed.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("source_key")), F.lit(0.0)))
    total = keyed.agg(F.sum("blocks"), F.count("*")).first()
    n_slots = int((total[0] or 0) * 9 // 8 + 64 * total[1])
    cells = keyed.where("blocks > 0").select("source_key", "low", "high", "blocks", F.explode(F.sequence(F.floor(F.col("low") * GRID), F.least(F.floor(F.col("high") * GRID), F.lit(GRID - 1)))).alias("cell"))
    points = spark.range(n_slots).withColumnRenamed("id", "slot")
    upper = F.floor(F.col("slot") / HALF) % HALF * (GOLDEN * HALF % PERIOD) % PERIOD
    points = points.withColumn("point", ((F.col("slot") % HALF * GOLDEN % PERIOD + upper) % PERIOD) / F.lit(float(PERIOD)))
    points = points.withColumn("cell", F.floor(F.col("point") * GRID))
    met = points.join(cells, "cell").where("point >= low and point < high").select("slot", "source_key", "blocks")
    met = met.withColumn("chunk", F.floor(F.col("slot") / (CHUNK_ROWS * 16)))
    ranked = _running(met, "source_key", "chunk", [F.col("slot")], F.lit(1), "rank").where("rank < blocks")
    ranked = stored(ranked.select("slot", "source_key", F.col("rank").cast("long").alias("rank")), "mix-slots")
    # ranks go up from 0 without gaps: what a source misses are its last ones
    reached = ranked.groupBy("source_key").agg(F.count("*").alias("reached"))
    missed = keyed.join(reached, "source_key", "left").select("source_key", "blocks", F.coalesce("reached", F.lit(0)).alias("reached")).where("reached < blocks")
    before = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, -1)
    missed = missed.withColumn("slot", n_slots + F.coalesce(F.sum(F.col("blocks") - F.col("reached")).over(before), F.lit(0)))
    missed = missed.select("source_key", "reached", "slot", F.explode(F.sequence(F.col("reached"), F.col("blocks") - 1)).alias("rank"))
    late = missed.select((F.col("slot") + F.col("rank") - F.col("reached")).alias("slot"), "source_key", "rank")
    return ranked.unionByName(late)


def mix(df: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_repeats: int = 2, seed: int = 10, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sizes, parts) for ``df`` with doc_id, source, text and, if named, a column that numbers its rows.

    sizes: row, doc_id, size, source_size, target of every document.
    parts: row, turn (0 for a document's first use), slot and words: what a slot takes of the document.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(f"`{row}`")
    narrow = df.select("doc_id", "source", word_count(F.col("text")).alias("size"), number.alias("row"))
    sizes = stored(narrow, "mix-sizes")
    wanted = stored(targets(sizes, weights, share, max_repeats), "mix-targets")
    line = lines(sizes, wanted, seed)
    turns = line.where("size > 0").select("row", "size", "source_key", "target", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("turn"), (F.col("start") + F.col("turn") * F.col("source_size")).alias("start"))
    # words up to the target only: the last block may be a part
    end = F.least(F.col("start") + F.col("size"), F.round("target").cast("long"))
    turns = turns.withColumn("end", end).where("end > start")
    cut = turns.withColumn("rank", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words))))
    words = F.least(F.col("end"), (F.col("rank") + 1) * block_words) - F.greatest(F.col("start"), F.col("rank") * block_words)
    parts = cut.withColumn("words", words).join(schedule(wanted, block_words), ["source_key", "rank"])
    return line.select("row", "doc_id", "size", "source_size", "target"), parts.select("row", "turn", "slot", "words")


def taken(df: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot of every document."""
    sizes, parts = mix(df, **options)
    sums = parts.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    out = sizes.join(sums, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def mixed_documents(df: DataFrame, slot: str | None = None, **options) -> DataFrame:
    """The documents of the mix, as whole rows with their columns: one for each use of which at least half is taken.

    Whole documents keep their texts; a use cut by the target is rounded.  Rows
    come in the order of the schedule: partitions hold ranges of slots one after
    the other, rows inside them follow their slots.  ``slot`` names a column for the
    slot in which a use begins.
    """
    if slot is not None and slot.lower() in map(str.lower, df.columns):
        raise ValueError(f"column {slot} exists; name another one")
    row, at = free_name("__row", df.columns), slot or free_name("__slot", df.columns)
    kept = stored(df.withColumn(row, F.monotonically_increasing_id()), "mix-documents")
    sizes, parts = mix(kept, row=row, **options)
    uses = parts.groupBy("row", "turn").agg(F.sum("words").alias("words"), F.min("slot").alias("slot")).join(sizes.select("row", "size"), "row")
    uses = uses.where("2 * words >= size").select(F.col("row").alias(row), F.col("slot").alias(at))
    mixed = kept.join(uses, row).repartitionByRange(partitions_of(df.sparkSession), at, row).sortWithinPartitions(at, row)
    return mixed.select(*(f"`{c}`" for c in df.columns), *([at] if slot else []))
