"""Hard negatives by Fagin's threshold algorithm.

Rows are integer vectors with a label.  For an anchor, rows are ranked by their
inner product with it (ties: smaller id).  Its positives are the first rows of
its label; the hard negatives of a positive are the first rows of other labels
whose score lies in a window below the positive's.

Anchors and candidates meet in blocks: a stripe of candidates and a block of
anchors are one task's stream, so that neither side is broadcast or collected.
Within a stripe each block of candidates holds one sorted list per dimension.  A
search reads the lists from the end that the anchor's sign prefers (sorted
access), scores each row it meets for the first time from its whole vector
(random access), and stops once the threshold, the score of a row at the present
depth of all lists, falls strictly below the kth score of every window, or below
the window itself.  Rows left unread can then not be among the first; a row that
ties with the kth would have a threshold equal to it.  The scores found in one
block of a stripe are the ones that the next block must reach.

Positives are searched among rows of the anchor's label only, negatives in all
stripes.  A label that holds a large share of the rows has as many stripes as
its rows ask for.  Partial results (at most k a window and stripe) meet in a
ranked window, which limits them before the shuffle.

The work is anchors times candidates in the worst case: in many dimensions with
evenly spread entries the threshold falls late and most rows are scored.

Cases: rows with a null label, a null vector, or a null or non-finite entry take
no part; shorter vectors count as padded with zeros.  A row without an id is no
anchor and comes after all ids in ties.  Repeated rows each count: an anchor's
own row is left out, a copy of it is another row.  An anchor without positives
or a window without rows gives no rows; a negative positive score has an empty
window.  Scores beyond a long are held at its ends.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markhive.llm.common import partitions_of, per_task, stored
from markhive.llm.vectors import Form, form_of, numbers, packed

#: Entries are scaled by this and floored.
SCALE = 256
#: Positives of an anchor, negatives of a positive, and the window in percent of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
#: Candidates of a stripe at most (and at least), candidates that share sorted lists, anchors of a block.
STRIPE, LEAST_STRIPE, BLOCK, ANCHORS = 1 << 17, 1 << 10, 1 << 13, 1 << 15
#: Depth of the first sorted access; each further one is twice as deep.
FIRST = 32
LAST = np.iinfo(np.int64).max
NONE = -LAST


def inner(rows: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; held at the ends of a long where they don't fit."""
    if not exact:
        whole = anchor.tolist()
        return np.array([min(max(sum(a * b for a, b in zip(r, whole, strict=True)), NONE + 1), LAST) for r in rows.tolist()], np.int64)
    return (rows @ anchor).astype(np.int64)


def number_type(form: Form) -> tuple[np.dtype, bool]:
    """The type in which inner products of the form's vectors are exact, and whether there is one."""
    bound = form.dim * form.largest**2
    for limit, kind in ((1 << 24, "f4"), (1 << 53, "f8"), (1 << 62, "i8")):
        if bound < limit:
            return np.dtype(kind), True
    return np.dtype("i8"), False


class Block:
    """Candidates with one sorted list of rows per dimension."""

    def __init__(self, x: np.ndarray, label: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.x, self.label, self.ids, self.rows = x, label, ids, rows
        self.rising = np.argsort(x.T, axis=1, kind="stable")
        self.values = np.take_along_axis(x.T, self.rising, axis=1)

    def lists(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Dimensions that count, whether their lists are read from the top, and the anchor's entries there."""
        used = np.flatnonzero(anchor)
        return used, anchor[used] > 0, anchor[used]

    def at(self, used: np.ndarray, falling: np.ndarray, start: int, end: int) -> np.ndarray:
        """The rows at these places of the lists (all of them, from each list's own end)."""
        n = len(self.x)
        return np.concatenate([self.rising[used[falling], n - end : n - start].ravel(), self.rising[used[~falling], start:end].ravel()])

    def frontier(self, used: np.ndarray, falling: np.ndarray, depth: int) -> np.ndarray:
        """The entry at a depth of each list."""
        return self.values[used, np.where(falling, len(self.x) - 1 - depth, depth)]


@dataclass
class Best:
    """The first k rows of each window of one anchor, in order: scores, ids and row numbers."""

    key: np.ndarray  # what a window belongs to
    low: np.ndarray
    high: np.ndarray
    score: np.ndarray  # a row of k for each window
    ids: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, key: list[int], low: list[int], high: list[int], k: int) -> Best:
        shape = (len(key), k)
        return cls(*(np.array(x, np.int64) for x in (key, low, high)), np.full(shape, NONE), np.full(shape, LAST), np.full(shape, LAST))

    def least(self) -> np.ndarray:
        """The score that a row must reach in each window."""
        return np.maximum(self.low, self.score[:, -1])

    def closed(self, threshold: int) -> bool:
        """Whether no row that scores at most ``threshold`` can change a window."""
        return bool((threshold < self.least()).all())

    def offer(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        least = self.least()
        some = np.flatnonzero((score >= least.min(initial=LAST)) & (score <= self.high.max(initial=NONE)))
        if not len(some):
            return
        score, ids, rows = score[some], ids[some], rows[some]
        for w in range(len(self.low)):
            fit = (score >= least[w]) & (score <= self.high[w])
            if fit.any():
                joined = [np.concatenate([old[w], new[fit]]) for old, new in ((self.score, score), (self.ids, ids), (self.rows, rows))]
                first = np.lexsort((joined[2], joined[1], -joined[0]))[: self.score.shape[1]]
                self.score[w], self.ids[w], self.rows[w] = (x[first] for x in joined)


def search(block: Block, anchor: np.ndarray, allowed: np.ndarray, best: Best, exact: bool = True) -> int:
    """Threshold algorithm over one block; returns the number of rows scored."""
    used, falling, weight = block.lists(anchor)
    n, scored = len(block.x), 0
    if not len(used):  # all rows score 0
        found = np.flatnonzero(allowed)
        best.offer(np.zeros(len(found), np.int64), block.ids[found], block.rows[found])
        return len(found)
    unread = allowed.copy()
    start, step, depth = 0, FIRST, 0
    while True:
        # the threshold at the next place of every list bounds all rows that are unread
        threshold = int(inner(block.frontier(used, falling, depth)[None, :], weight, exact)[0])
        if best.closed(threshold):
            return scored
        end = min(n, start + step)
        met = np.zeros(n, bool)
        met[block.at(used, falling, start, end)] = True
        fresh = np.flatnonzero(met & unread)
        if len(fresh):
            unread[fresh] = False
            scored += len(fresh)
            best.offer(inner(block.x[fresh], anchor, exact), block.ids[fresh], block.rows[fresh])
        if end == n or not unread.any():
            return scored
        start, step, depth = end, 2 * step, end - 1


# ------------------------------------------------------------------ tasks

#: A stream's rows: its number, 0 for anchors and 1 for candidates, and what belongs to each.
STREAM = ("stream", "candidate", "row", "id", "label", "vector", "key", "low", "high")
FOUND = "anchor long, key long, score long, id long, row long"


def _searched(batches: Iterable[pa.RecordBatch], form: Form, k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """Runs each stream's anchors over its candidates, a block at a time; rows come sorted by stream, anchors first."""
    kind, exact = number_type(form)
    before, anchors, waiting = (None, False), [], []

    def read() -> None:
        """The candidates that wait, as one block, for all anchors of the stream."""
        if not waiting or not anchors:
            waiting.clear()
            return
        x, label, ids, rows = (np.concatenate(c) for c in zip(*waiting, strict=True))
        waiting.clear()
        block = Block(x, label, ids, rows)
        for vector, own_label, own_row, best in anchors:
            allowed = (label == own_label) & (rows != own_row) if same else label != own_label
            search(block, vector, allowed, best, exact)

    def told() -> Iterator[pa.RecordBatch]:
        read()
        for i in range(0, len(anchors), 1024):
            some = [(row, best) for _, _, row, best in anchors[i : i + 1024]]
            columns = [
                np.concatenate([np.full(b.score.size, row) for row, b in some]),
                np.concatenate([np.repeat(b.key, k) for _, b in some]),
                *(np.concatenate([getattr(b, name).ravel() for _, b in some]) for name in ("score", "ids", "rows")),
            ]
            real = columns[2] > NONE
            yield pa.RecordBatch.from_arrays([pa.array(c[real]) for c in columns], names=["anchor", "key", "score", "id", "row"])
        anchors.clear()

    for batch in batches:
        numbered = batch.column("stream").to_numpy()
        candidate = batch.column("candidate").to_numpy()
        cuts = np.flatnonzero(np.r_[True, (numbered[1:] != numbered[:-1]) | (candidate[1:] != candidate[:-1])])
        for start, end in zip(cuts, np.r_[cuts[1:], batch.num_rows], strict=True):
            now = (numbered[start], bool(candidate[start]))
            if now[0] != before[0] or before[1] and not now[1]:
                yield from told()
            before = now
            part = batch.slice(start, end - start)
            x = numbers(part.column("vector"), form).astype(kind)
            label, row = part.column("label").to_numpy(), part.column("row").to_numpy()
            if candidate[start]:
                ids = part.column("id").fill_null(LAST).to_numpy()
                for i in range(0, len(x), BLOCK):
                    waiting.append((x[i : i + BLOCK], label[i : i + BLOCK], ids[i : i + BLOCK], row[i : i + BLOCK]))
                    if sum(len(w[0]) for w in waiting) >= BLOCK:
                        read()
            else:
                windows = zip(*(part.column(c).to_pylist() for c in ("key", "low", "high")), strict=True)
                anchors += [(x[i], label[i], row[i], Best.of(*w, k)) for i, w in enumerate(windows)]
    yield from told()


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each anchor and window, with their rank."""
    order = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _stripe_rows(spark, rows: int) -> int:
    """Candidates of a stripe: two stripes for each task, none above STRIPE."""
    return min(STRIPE, max(LEAST_STRIPE, -(-rows // (2 * partitions_of(spark)))))


def _dealt(anchors: DataFrame, candidates: DataFrame, form: Form, k: int, same: bool, group: list[str]) -> DataFrame:
    """Searches ``candidates`` for ``anchors``; both have their group's number of stripes and anchor blocks."""
    side = lambda df, n, seed: F.pmod(F.xxhash64(F.lit(seed), "row"), F.col(n))
    a = anchors.withColumn("block", side(anchors, "blocks", 1)).withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stripes") - 1)))
    c = candidates.withColumn("stripe", side(candidates, "stripes", 2)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    whole = a.withColumn("candidate", F.lit(0)).unionByName(c.withColumn("candidate", F.lit(1)), allowMissingColumns=True)
    whole = whole.withColumn("stream", F.xxhash64(*group, "block", "stripe"))
    dealt = whole.repartition(partitions_of(anchors.sparkSession), "stream").sortWithinPartitions("stream", *group, "block", "stripe", "candidate")
    return per_task(dealt.select(*STREAM), _searched, FOUND, form, k, same)


# ------------------------------------------------------------------ the operator


def mine(
    df: DataFrame,
    anchors: Column,
    id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: float = SCALE,
) -> DataFrame:
    """Hard negatives of the rows that ``anchors`` holds for.

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score:
    for each anchor and each of its first ``positives`` rows of the same label,
    the first ``negatives`` rows of other labels whose score is ``low`` to
    ``high`` percent of the positive's.  Ids are longs, labels integers.
    """
    spark = df.sparkSession
    form = form_of(df, vector, scale)
    taken = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    # rows are numbered once, in a table: every later job sees the same numbers
    rows = stored(packed(taken.where("label is not null"), "vector", scale, form).withColumn("row", F.monotonically_increasing_id()), "vectors")
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("is_anchor").cast("long")).alias("n_anchors"))
    n, n_anchors = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_anchors"), F.lit(0))).first()
    stripe = _stripe_rows(spark, n)

    # positives: streams hold rows of one label
    sizes = counts.where("n_anchors > 0").select("label", F.ceil(F.col("n") / stripe).alias("stripes"), F.ceil(F.col("n_anchors") / ANCHORS).alias("blocks"))
    sized = rows.join(sizes, "label")
    every = lambda v: F.array(F.lit(v).cast("long"))
    asking = sized.where("is_anchor").withColumns({"key": every(0), "low": every(NONE), "high": every(LAST)})
    found = _first(_dealt(asking, sized, form, positives, True, ["label"]), positives)
    known = rows.where("is_anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "label", "vector")
    pairs = stored(found.select("anchor", F.nullif("id", F.lit(LAST)).alias("positive_id"), F.col("score").alias("positive_score"), F.col("row").alias("positive")), "positives")

    # negatives: all rows, in stripes; a window for each positive score that is not negative
    windows = pairs.where("positive_score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("key"))
    # low * positive <= 100 * negative <= high * positive, as bounds of the negative's score
    percent = lambda s, share: s.cast("decimal(38,0)") * share / 100
    asking = known.join(windows, "anchor").select(
        F.col("anchor").alias("row"),
        "label",
        "vector",
        "key",
        F.transform("key", lambda s: F.ceil(percent(s, low)).cast("long")).alias("low"),
        F.transform("key", lambda s: F.floor(percent(s, high)).cast("long")).alias("high"),
    )
    many = {"stripes": F.lit(max(1, -(-n // stripe))).cast("long"), "blocks": F.lit(max(1, -(-n_anchors // ANCHORS))).cast("long")}
    found = _first(_dealt(asking.withColumns(many), rows.withColumns(many), form, negatives, False, []), negatives)
    negatives_of = found.select("anchor", F.col("key").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.nullif("id", F.lit(LAST)).alias("negative_id"), F.col("score").alias("negative_score"))
    out = pairs.join(negatives_of, ["anchor", "positive_score"]).join(known.select("anchor", "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def of_hundredths(df: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 100; a seventh of the labels is moved first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(df.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


def oracle_sql(scale: int = SCALE, anchor: str = "vec_id % 100 = 0") -> str:
    """The same rows in DuckDB SQL: all scores of all anchors."""
    return f"""
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label,
           CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM whole a JOIN whole b ON a.vec_id <> b.vec_id
    WHERE a.{anchor}),
positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score,
           row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place
    FROM scored WHERE label = own QUALIFY place <= {POSITIVES})
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id
WHERE s.label <> s.own AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
QUALIFY rank <= {NEGATIVES}"""
