"""Near-duplicate groups by n-gram Jaccard similarity, with a token-group matrix.

A document's tokens are its distinct word shingles.  Two documents are linked
when ``100 * |A & B| >= percent * |A | B|``; groups are the components of all links.

1. Documents with equal sets are one class, represented by its smallest doc_id.
2. Similar representatives are partitioned into groups: documents that share a
   min-hash band are compared with the smallest document of the band (a star, not
   all pairs).  The links found connect documents to components; a document's
   group is its component, or the smallest document that it shares a band with.
   Groups are cut into blocks of about BLOCK members.
3. The matrix holds each block's token union.  For a set of n tokens any partner
   holds at least ``need(n) = ceil(percent * n / 100)`` of them, and linked sets of
   n and m tokens share ``both = ceil(percent * (n + m) / (100 + percent))``.  In
   one global order of tokens they therefore share
   ``DEPTH + both - max(need(n), need(m))`` tokens among the first
   ``n - need(n) + DEPTH`` of each.  These rows of the matrix are enough to
   bound the overlap of a document and a block: blocks that share fewer tokens
   than any of their sizes allows hold no partner and are never opened.
4. Qualifying blocks are opened: the overlap with the block's full union bounds
   the similarity once more, then all members' overlaps are counted exactly, from
   the block's tokens in one sorted array.  Members of the document's own
   component are passed over, and one link to each other component is enough.

The order puts shingles with rare words first.  A word's count comes from a table
of CELLS hashed counters over all documents; it orders tokens and never decides
a link.  So rows of hot passages stay out of the matrix unless a document has
little else, and large groups of copies meet as one group, not as pairs.

Cases: null and empty texts have no tokens and are linked with nothing; texts of
fewer words than a shingle have one token, the whole sequence; tokens are 64-bit
hashes.  Rows with a null doc_id don't link others; repeated rows are equal sets.
Very long texts are one set of hashes each.  Where doc_ids repeat, rows are numbered
first and everything goes by row.  Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markhive.llm.common import per_task, partitions_of, pieces, stored, text_bytes
from markhive.llm.components import components
from markhive.llm.idfilter import id_filter, maybe_in, surely_not_in
from markhive.llm.vectors import free_name
from markhive.llm.word_hash import hashed_words, spread

#: Hashed counters of words (4 MB in each worker).
CELLS = 1 << 20
#: Tokens that linked sets share in the matrix.
DEPTH = 4
#: Min-hash bands, and hashes of a band.
BANDS, WIDTH = 4, 2
#: Members of a block, and queries that meet a block in one run of a task.
BLOCK, QUERIES = 64, 512
#: Places in which a group's members meet its size.
SALTS = 16
STEP = np.uint64(0x9E3779B97F4A7C15)


def _shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` words; of the whole sequence if it is shorter."""
    if not len(h):
        return h
    size = min(width, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            out = spread(out * STEP + h[k : len(h) - size + 1 + k])
    return out


def token_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    words, places = hashed_words(texts)
    for a, b in zip(places, places[1:], strict=False):
        yield np.unique(_shingles(words[a:b], width))


# ------------------------------------------------------------------ counters


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for batch in pieces(batches):
        words, _ = hashed_words(batch.column("text").to_pylist())
        counts += np.bincount((words >> np.uint64(44)).astype(np.int64), minlength=CELLS)
    cells = np.flatnonzero(counts)
    for b in range(0, len(cells), 1 << 16):
        some = cells[b : b + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["cell", "n"])


def word_counters(df: DataFrame):
    """Counts of hashed words over all texts, as a broadcast array of CELLS numbers."""
    found = per_task(df.select(text_bytes().alias("text")), _counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return df.sparkSession.sparkContext.broadcast(np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32))


# ------------------------------------------------------------------ sets


def need(n: np.ndarray | int, percent: int):
    """Tokens of a set of n that any partner holds at least."""
    return -(-percent * n // 100)


def _described(batches: Iterable[pa.RecordBatch], counters, width: int, percent: int) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        multipliers = spread(np.arange(1, BANDS * WIDTH + 1, dtype=np.uint64) * STEP) | np.uint64(1)
    for batch in pieces(batches):
        n, high, low, bands, first = [], [], [], [], []
        words, places = hashed_words(batch.column("text").to_pylist())
        counts = counters.value[(words >> np.uint64(44)).astype(np.int64)]
        for a, b in zip(places, places[1:], strict=False):
            h = words[a:b]
            s = _shingles(h, width)
            tokens, at = np.unique(s, return_index=True)
            n.append(len(tokens))
            high.append(xxhash.xxh3_64_intdigest(tokens.tobytes(), 1))
            low.append(xxhash.xxh3_64_intdigest(tokens.tobytes(), 2))
            if not len(tokens):
                bands.append([])
                first.append(np.empty(0, np.int64))
                continue
            count = counts[a:b]
            size = min(width, len(h))
            rarest = count[: len(s)]
            for k in range(1, size):
                rarest = np.minimum(rarest, count[k : k + len(s)])
            keep = min(len(tokens), len(tokens) - need(len(tokens), percent) + DEPTH)
            order = np.lexsort((tokens, rarest[at]))[:keep]
            first.append(tokens[order].view(np.int64))
            with np.errstate(over="ignore"):
                mins = _least_products(tokens, multipliers).reshape(BANDS, WIDTH)
                band = np.arange(BANDS, dtype=np.uint64)
                for k in range(WIDTH):
                    band = spread(band * STEP + mins[:, k])
            bands.append(band.view(np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in first])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n, pa.int64()),
                pa.array(np.array(high, np.uint64).view(np.int64)),
                pa.array(np.array(low, np.uint64).view(np.int64)),
                pa.array(bands, pa.list_(pa.int64())),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *first]))),
            ],
            names=["doc_id", "n", "high", "low", "bands", "first"],
        )


def _least_products(tokens: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """For each multiplier the least product, in steps that bound the memory."""
    out = np.full(len(multipliers), np.iinfo(np.uint64).max)
    for k in range(0, len(tokens), 1 << 14):
        np.minimum(out, (tokens[k : k + (1 << 14)] * multipliers[:, None]).min(axis=1), out=out)
    return out


def size_classes(percent: int) -> list[int]:
    """Lower bounds of classes of set sizes; linked sets lie in the same or in neighbouring classes."""
    bounds = [1]
    while bounds[-1] < 1 << 31:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return bounds


# ------------------------------------------------------------------ opening blocks


class _Block:
    """A block's members and the tokens of all of them in one sorted array."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]]):
        self.docs = np.array([d for d, _, _ in members], np.int64)
        self.parts = np.array([p for _, p, _ in members], np.int64)
        self.sizes = np.array([len(t) for _, _, t in members], np.int64)
        tokens = np.concatenate([np.empty(0, np.uint64), *(t for _, _, t in members)])
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], np.repeat(np.arange(len(members)), self.sizes)[order]

    def partners(self, doc: int, part: int, tokens: np.ndarray, percent: int) -> np.ndarray:
        """One linked member of each component other than ``part``."""
        n = len(tokens)
        left, right = np.searchsorted(self.tokens, tokens, "left"), np.searchsorted(self.tokens, tokens, "right")
        held = right > left
        if 100 * int(held.sum()) < percent * n:
            return self.docs[:0]  # the bound: no member can be similar enough
        left, count = left[held], (right - left)[held]
        ends = np.cumsum(count)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(left - ends + count, count)
        both = np.bincount(self.owner[at], minlength=len(self.docs))
        linked = np.flatnonzero((100 * both >= percent * (n + self.sizes - both)) & (self.parts != part) & (both > 0))
        return self.docs[linked[np.unique(self.parts[linked], return_index=True)[1]]]


def _opened(batches: Iterable[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between queries and members of blocks, from rows sorted by block, run and role."""
    at, members, block = None, [], None
    for batch in pieces(batches):
        left, right = [], []
        sets = token_sets(batch.column("text").to_pylist(), width)
        rows = zip(*(batch.column(c).to_pylist() for c in ("group", "block", "run", "role", "doc_id", "part")), sets, strict=True)
        for group, number, run, role, doc, part, tokens in rows:
            if (group, number, run) != at:
                at, members, block = (group, number, run), [], None
            if not role:
                members.append((doc, part, tokens))
                continue
            if block is None:
                block = _Block(members)
            if len(tokens):
                found = block.partners(doc, part, tokens, percent)
                left += [doc] * len(found)
                right += found.tolist()
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _open(texts: DataFrame, candidates: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between ``candidates`` (group, block, query, part) and ``members`` (group, block, doc_id, part)."""
    # queries of a block are dealt to runs of about QUERIES, each with the block's members
    runs = candidates.groupBy("group", "block").agg(F.ceil(F.count("*") / QUERIES).alias("runs"))
    asked = candidates.join(runs, ["group", "block"]).select("group", "block", F.pmod(F.xxhash64("query"), "runs").alias("run"), F.lit(1).alias("role"), F.col("query").alias("doc_id"), "part")
    held = members.join(runs, ["group", "block"]).select("group", "block", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(0).alias("role"), "doc_id", "part")
    rows = stored(asked.unionAll(held), "join-rows")
    wanted = rows.select("doc_id").distinct()
    own = maybe_in(texts, "doc_id", id_filter(wanted))
    n = partitions_of(texts.sparkSession)
    met = rows.join(own, "doc_id").select("group", "block", "run", "role", "doc_id", "part", "text")
    met = met.repartition(n, "group", "block", "run").sortWithinPartitions("group", "block", "run", "role", "doc_id")
    return per_task(met, _opened, "a long, b long", width, percent)


# ------------------------------------------------------------------ the join


def _least_shared(n: str, m: str, percent: int) -> Column:
    """Tokens that linked sets of n and m tokens share in the matrix at least."""
    both = f"(({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent})"
    needed = f"greatest(({percent} * {n} + 99) div 100, ({percent} * {m} + 99) div 100)"
    return F.expr(f"least({both}, {DEPTH} + {both} - {needed})")


def least_shared(n: str, low: str, high: str, percent: int) -> Column:
    """Tokens that a set of n tokens shares in the matrix with any linked set of low to high tokens, at least.

    Without rounding the least share over the sizes is at an end.  A rounded-up
    share less a rounded-up need lies within 1 of what it is unrounded, so a size
    between the ends may hold one less than both ends, but no less than the
    unrounded share at an end, rounded down.
    """
    ends = F.least(_least_shared(n, low, percent), _least_shared(n, high, percent))
    whole = 100 * (100 + percent)
    unrounded = [F.expr(f"({DEPTH * whole} + {100 * percent} * ({n} + {m}) - {(100 + percent) * percent} * greatest({n}, {m})) div {whole}") for m in (low, high)]
    between = F.greatest(F.lit(1), ends - 1, F.least(ends, *unrounded))
    return F.when(F.expr(f"{low} >= {high}"), ends).otherwise(between)


def _repeats(df: DataFrame) -> bool:
    """Whether a doc_id comes more than once."""
    return not df.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def groups(df: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``df`` (doc_id, text).

    Rows are documents: of a doc_id that comes with several texts each row has
    its own links, and components are named by their smallest doc_id.
    """
    if not _repeats(df):
        return _groups(df, width, percent)
    rows = stored(df.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "join-numbered")
    found = stored(_groups(rows.select(_row_with_id(), "text"), width, percent), "join-by-row")
    ids = rows.select("row", F.col("doc_id").alias("id"))
    named = found.join(ids, found["doc_id"] == ids["row"], "left").drop("row", "doc_id")
    least = named.groupBy("component_id").agg(F.min("id").alias("least"))
    return named.join(least, "component_id", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))


def _row_with_id(row: str = "row") -> Column:
    return F.when(F.col("doc_id").isNotNull(), F.col(row)).alias("doc_id")


def _groups(df: DataFrame, width: int, percent: int) -> DataFrame:
    """``groups`` where every doc_id comes once."""
    texts = df.select("doc_id", text_bytes().alias("text"))
    counters = word_counters(df)
    sets = stored(per_task(texts, _described, "doc_id long, n long, high long, low long, bands array<long>, first array<long>", counters, width, percent), "join-sets")
    classes = stored(sets.where("n > 0").groupBy("n", "high", "low").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "join-classes")
    # one row for a representative, also where its doc_id is repeated
    reps = sets.select("n", "bands", "first", "high", "low", F.col("doc_id").alias("rep")).join(classes, ["n", "high", "low", "rep"], "left_semi").dropDuplicates(["rep", "high", "low"])
    reps = stored(reps.select("rep", "n", "bands", "first"), "join-reps")

    # groups: stars around the smallest document of a band
    bands = reps.select("rep", F.explode("bands").alias("band"))
    centers = bands.groupBy("band").agg(F.min("rep").alias("center"), F.max("rep").alias("other")).where("center < other")
    stars = bands.join(centers, "band").where("rep <> center").select(F.col("center").alias("group"), F.lit(0).alias("block"), F.col("rep").alias("query"), F.col("rep").alias("part")).distinct()
    stars = stored(stars, "join-stars")
    own = stars.select("group", "block").distinct().select("group", "block", F.col("group").alias("doc_id"), F.col("group").alias("part"))
    links = stored(_open(texts, stars, own, width, percent), "join-links")
    connected = stored(components(links), "join-connected")

    # the matrix: first tokens of every block
    nearest = stars.groupBy("query").agg(F.min("group").alias("near"))
    placed = reps.select("rep", "n").join(connected, F.col("rep") == F.col("node"), "left").join(nearest, F.col("rep") == F.col("query"), "left")
    placed = placed.select("rep", "n", F.coalesce("root", "rep").alias("part"), F.coalesce("root", F.least("near", "rep"), "rep").alias("group"))
    sizes = placed.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    # a large group's members meet its size in several places
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64(F.lit(4), "rep"), F.lit(SALTS)))
    placed = stored(placed.join(sizes, ["group", "salt"]).select("rep", "n", "part", "group", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block")), "join-placed")
    bounds = size_classes(percent)
    size_class = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda b: b <= F.col("n")))
    # narrow rows until only tokens that documents share are left
    held = reps.select("rep", F.explode("first").alias("token"))
    shared = held.groupBy("token").agg(F.min("rep").alias("one"), F.max("rep").alias("two")).where("one < two").select("token")
    cells = held.join(shared, "token", "left_semi").join(placed, "rep").select("token", "rep", "n", "part", "group", "block", size_class.alias("size"))
    cells = stored(cells, "join-cells")
    matrix = cells.groupBy("token", "size", "group", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("part").alias("one"), F.max("part").alias("two"))
    # a document asks its own class up to its own block, and all of the class above
    asks = cells.select(F.col("rep").alias("query"), "n", "part", F.col("group").alias("g"), F.col("block").alias("b"), F.col("size").alias("s"), F.explode(F.array("size", F.col("size") + 1)).alias("size"), "token")
    met = asks.join(matrix, ["token", "size"]).where("(size > s or `group` < g or (`group` = g and block <= b)) and (one <> part or two <> part)")
    found = met.groupBy("query", "n", "part", "group", "block", "size").agg(F.count("*").alias("shared"), F.min("low").alias("low"), F.max("high").alias("high"))
    # sizes of the block that can be linked with n at all
    found = found.withColumn("low", F.expr(f"greatest(low, ({percent} * n + 99) div 100)")).withColumn("high", F.expr(f"least(high, 100 * n div {percent})"))
    enough = F.col("shared") >= least_shared("n", "low", "high", percent)
    candidates = stored(found.where((F.col("low") <= F.col("high")) & enough).select("group", "block", "query", "part").distinct(), "join-candidates")
    members = placed.select("group", "block", F.col("rep").alias("doc_id"), "part").join(candidates.select("group", "block").distinct(), ["group", "block"], "left_semi")
    more = _open(texts, candidates, members, width, percent)

    roots = stored(components(connected.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more)), "join-roots")
    named = classes.join(roots, classes["rep"] == roots["node"], "left").select("n", "high", "low", F.coalesce("root", "rep").alias("component_id"))
    out = sets.select("doc_id", "n", "high", "low").join(named, ["n", "high", "low"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(df: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of every group, the one with the smallest doc_id, with its columns.

    Rows with a null doc_id stay.  Of rows that repeat a doc_id those stay that are
    in different groups, each unless its group has a smaller doc_id (or, of equal
    ones, an earlier row); texts without words are in no group and all stay.
    """
    if not _repeats(df):
        found = stored(groups(df, width, percent), "join-result")
        gone = found.where("doc_id <> component_id").select("doc_id")
        bits = id_filter(gone)
        checked = maybe_in(df, "doc_id", bits).join(gone, "doc_id", "left_anti")
        return surely_not_in(df, "doc_id", bits).unionByName(checked).select(*(f"`{c}`" for c in df.columns))
    row = free_name("__row", df.columns)
    rows = stored(df.withColumn(row, F.monotonically_increasing_id()), "join-numbered")
    found = stored(_groups(rows.select(_row_with_id(row), "text"), width, percent), "join-by-row")
    ids = rows.where("doc_id is not null").select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    named = found.join(ids, found["doc_id"] == ids["row"]).select("component_id", F.struct("id", "row").alias("member"))
    first = named.groupBy("component_id").agg(F.min("member").alias("first")).select(F.col("first.row").alias("row"))
    gone = ids.join(first, "row", "left_anti").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").select(*(f"`{c}`" for c in df.columns))
