"""Scores of texts under a smoothed n-gram model, kept in Elias-Fano tries.

Tokens are lower-cased (A-Z) words and one end per text.  The model is a bigram
model over a unigram model, with absolute discounting and interpolation:

    p(w | h) = max(c(h, w) - D, 0) / c(h)  +  D * types(h) / c(h) * p(w)
    p(w)     = (c(w) - D1) / N,            unknown words: D1 * V / N

(h without counts: p(w)).  The first term is quantised to 255 steps of its
logarithm, rounded down, so that the sum of all p stays at most 1.

1. Documents are cut into blocks of about BLOCK tokens: a vocabulary of word
   hashes and the tokens as numbers into it, as bytes; written once.
2. Every block sends its distinct bigrams, with training counts, to cells.  A
   cell is a range of context hashes that holds about CELL tokens, so cells grow
   in number, not in size.  Contexts of more than HOT training tokens (at most
   N / HOT words; no more than a cell's tokens, so that one context doesn't make
   a cell several times as large) are split by the successor's hash into contexts of their own.
3. A cell goes through ranges of its contexts, of RANGE bigrams of its blocks or
   one context.  A range adds the counts, builds its trie and asks it once for
   each bigram.  The cell answers every block: for each bigram its code, for each
   context its count and types.  The trie's levels are read as they are packed,
   in an anonymous memory map of the cell's task.
4. A block and its answers come to a task one after the other, in one sorted
   stream; there they are put together and the documents' scores are summed.

Counts cover all documents that are not held out.  Words are told apart by 64
hashed bits, a context's successors by 40.  Nothing is sampled or cut.

Cases: null and empty texts are one end token; a very long text is a block of its own.  A null doc_id is not held out.
Without training documents all scores are 0.  Repeated rows are scored alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markhive.llm.common import bounded_batches, drop_shuffles, partitions_of, per_task, pieces, stored, text_bytes
from markhive.llm.elias_fano import Trie
from markhive.llm.word_hash import hashed_words, spread

#: Tokens of a block and, about, of a cell; training tokens from which a context is split.
BLOCK, CELL, HOT = 1 << 19, 1 << 18, 1 << 18
#: Hashed counters that find the words that may be hot.
CELLS = 1 << 16
#: Bigrams of a range of a cell's contexts, as its blocks send them: the memory of a cell beside what is sent.
RANGE = 1 << 17
#: Answers of a row group, so that a reader holds a few MB of them.
ANSWERS = 1 << 9
#: Bigrams that a trie is asked for at once.
ASKED = 1 << 16
#: Discount of bigram counts.
DISCOUNT = 0.75
#: Quantiser: codes 1 to 255 for probabilities from 1e-8 to 1.
FLOOR, STEPS = -8.0, 254
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Numbers of the end token and of the context of a text's first token.
END, START = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def quantised(p: np.ndarray) -> np.ndarray:
    return (1 + np.clip(np.floor((np.log10(p) - FLOOR) / -FLOOR * STEPS), 0, STEPS)).astype(np.uint8)


#: Probability of each code.
VALUES = np.r_[0.0, 10 ** (FLOOR - np.arange(STEPS + 1) * FLOOR / STEPS)]


# ------------------------------------------------------------------ blocks

BLOCK_FIELDS = "block long, doc_ids array<long>, held binary, sizes binary, words binary, tokens binary, n_tokens long, train_tokens long, train_docs long"


def _block(number: int, docs: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
    held = np.array([held_out(d) for d, _ in docs])
    sizes = np.array([len(t) for _, t in docs], np.int64)
    words, tokens, counts = np.unique(np.concatenate([t for _, t in docs]), return_inverse=True, return_counts=True)
    often = np.argsort(-counts, kind="stable")  # small numbers for frequent words compress well
    place = np.empty(len(words), np.int64)
    place[often] = np.arange(len(words))
    row = {
        "block": [number],
        "doc_ids": [[d for d, _ in docs]],
        "held": [held.tobytes()],
        "sizes": [sizes.astype("<i8").tobytes()],
        "words": [words[often].astype("<u8").tobytes()],
        "tokens": [_planes(place[tokens], len(words))],
        "n_tokens": [len(tokens)],
        "train_tokens": [int(sizes[~held].sum())],
        "train_docs": [int((~held).sum())],
    }
    types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, *[pa.int64()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], names=list(row))


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    docs, held = [], 0
    for batch in pieces(batches):
        words, places = hashed_words(batch.column("text").to_pylist())
        for doc, a, b in zip(batch.column("doc_id").to_pylist(), places, places[1:], strict=False):
            tokens = np.append(words[a:b], END)
            if docs and held + len(tokens) > BLOCK:
                yield _block(number, docs)
                number, docs, held = number + 1, [], 0
            docs.append((doc, tokens))
            held += len(tokens)
    if docs:
        yield _block(number, docs)


def _planes(numbers: np.ndarray, top: int) -> bytes:
    """Numbers below ``top``: all their lowest bytes, then all their second bytes and so on, which compress well."""
    width = max(1, -(-(top - 1).bit_length() // 8))
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()


class _Block:
    """A row of BLOCK_FIELDS, read inside its batch."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.doc_ids = batch.column("doc_ids")[i].values if "doc_ids" in batch.schema.names else None
        self.words, self.sizes, self.held = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("words", "<u8"), ("sizes", "<i8"), ("held", bool)))
        planes = np.frombuffer(batch.column("tokens")[i].as_buffer(), np.uint8).reshape(-1, int(self.sizes.sum()))
        self.tokens = planes[0].astype(np.int32)
        for k in range(1, len(planes)):
            self.tokens |= planes[k].astype(np.int32) << 8 * k


class _Bigrams:
    """A block's distinct bigrams, by context hash and successor; the same whenever it is made."""

    def __init__(self, block: _Block, hot: tuple[np.ndarray, np.ndarray]):
        self.block = block
        own, before = block.words[block.tokens], self.before()
        with np.errstate(over="ignore"):
            context = spread(before)
            names, parts = hot
            split, at = np.empty(0, np.int64), np.empty(0, np.int64)
            if len(names):
                at = np.searchsorted(names, before)
                at[at == len(names)] = 0
                split = np.flatnonzero(names[at] == before)
                at = at[split]
                part = own[split] % parts[at]
                context[split] = spread(context[split] + (part + np.uint64(1)) * STEP)
        del before
        # one bit less, so that contexts are non-negative numbers
        self.contexts, place = np.unique((context >> np.uint64(1)).view(np.int64), return_inverse=True)
        #: of each context, the place of the hot word that it is a part of; -1 for none
        self.part_of = np.full(len(self.contexts), -1, np.int32)
        self.part_of[place[split]] = at
        del context, split, at
        place <<= Trie.BITS
        place |= (own >> np.uint64(64 - Trie.BITS)).view(np.int64)
        del own
        self.keys, entry = np.unique(place, return_inverse=True)
        self.entry = entry.astype(np.int32)

    def before(self) -> np.ndarray:
        """Context of each token."""
        sizes = self.block.sizes
        before = np.empty(len(self.block.tokens), np.uint64)
        before[1:] = self.block.words[self.block.tokens[:-1]]
        before[np.cumsum(sizes) - sizes] = START
        return before

    def counts(self) -> np.ndarray:
        """Training count of each bigram."""
        train = np.repeat(~self.block.held, self.block.sizes)
        return np.bincount(self.entry[train], minlength=len(self.keys)).astype(np.uint32)


REQUEST_FIELDS = "cell long, block long, contexts binary, sizes binary, successors binary, counts binary, parts binary"


def _cell_of(contexts: np.ndarray, n_cells: int) -> np.ndarray:
    return (contexts >> 32) * n_cells >> 31


def _requests(batches: Iterable[pa.RecordBatch], n_cells: int, hot) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _request(batch, i, n_cells, hot.value)


def _request(batch: pa.RecordBatch, i: int, n_cells: int, hot: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    own = _Bigrams(_Block(batch, i), hot)
    counts = own.counts()
    cells, first = np.unique(_cell_of(own.contexts, n_cells), return_index=True)
    bounds = np.r_[first, len(own.contexts)]
    at = np.searchsorted(own.keys, bounds << Trie.BITS)  # the cells' first bigrams
    sizes = np.bincount(own.keys >> Trie.BITS, minlength=len(own.contexts)).astype(np.uint32)
    ids = (own.keys & ((1 << Trie.BITS) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : Trie.BITS // 8]
    columns = [
        pa.array(cells),
        pa.array(np.full(len(cells), batch.column("block")[i].as_py())),
        _sliced(own.contexts, bounds),
        _sliced(sizes, bounds),
        _sliced(np.ascontiguousarray(ids), at),
        _sliced(counts, at),
        pa.array([_parts(own.part_of[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in REQUEST_FIELDS.split(", ")])


def _parts(part_of: np.ndarray) -> bytes | None:
    """(place of context, place of hot word) pairs of the contexts that are parts; mostly there are none."""
    own = np.flatnonzero(part_of >= 0)
    return np.stack([own, part_of[own]], axis=1).astype(np.int32).tobytes() if len(own) else None


def _sliced(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value for each slice."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offsets = pa.py_buffer((bounds * width).astype(np.int32).tobytes())
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(values.tobytes())])


# ------------------------------------------------------------------ cells

ANSWER_FIELDS = "block long, cell long, codes binary, totals binary, types binary, seen array<long>, hot array<long>, hot_types array<long>"


def _answers(batches: Iterable[pa.RecordBatch], hot) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    cell = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "block", "contexts", "sizes", "successors", "counts", "parts")), strict=True):
            if row[0] != cell and held:
                yield _answer(cell, held, hot.value)
                held = []
            cell = row[0]
            held.append(row[1:])
    if held:
        yield _answer(cell, held, hot.value)


def _answer(cell: int, rows: list[tuple], hot: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """Adds the rows' counts, builds the tries of the cell's ranges, answers the rows."""
    contexts = [np.frombuffer(r[1], np.int64) for r in rows]
    sizes = [np.frombuffer(r[2], np.uint32) for r in rows]
    names, place = np.unique(np.concatenate(contexts), return_inverse=True)
    ends = np.cumsum(np.bincount(place, weights=np.concatenate(sizes), minlength=len(names))).astype(np.int64)
    at = np.split(place.astype(np.int32), np.cumsum([len(c) for c in contexts])[:-1])
    del place
    # a part of a split context divides by the whole context's count
    part_of = np.full(len(names), -1, np.int64)
    for own, row in zip(at, rows, strict=True):
        if row[5]:
            told = np.frombuffer(row[5], np.int32).reshape(-1, 2)
            part_of[own[told[:, 0]]] = told[:, 1]
    words, totals = hot
    total, types = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    cuts = [0]
    while cuts[-1] < len(names):
        done = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, done + RANGE, "right"))))
    # of each row: the first of its contexts, and of its bigrams, in each range
    firsts = [np.searchsorted(a, cuts) for a in at]
    begins = [np.r_[0, np.cumsum(n, dtype=np.int64)][f] for n, f in zip(sizes, firsts, strict=True)]
    codes: list[list[bytes]] = [[] for _ in rows]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        of = np.concatenate([x[f[k] : f[k + 1]] for x, f in zip(at, firsts, strict=True)]) - a
        of = np.repeat(of, np.concatenate([n[f[k] : f[k + 1]] for n, f in zip(sizes, firsts, strict=True)]))
        spans = [(int(f[k]), int(f[k + 1])) for f in begins]
        successors = b"".join(memoryview(r[3])[x * Trie.BITS // 8 : y * Trie.BITS // 8] for r, (x, y) in zip(rows, spans, strict=True))
        counts = np.concatenate([np.frombuffer(r[4], np.uint32)[x:y] for r, (x, y) in zip(rows, spans, strict=True)])
        whole = np.where(part_of[a:b] >= 0, totals[part_of[a:b]], 0) if len(totals) else np.zeros(b - a, np.int64)
        answer, total[a:b], types[a:b] = _answer_range(names[a:b], of, successors, counts, whole)
        x = 0
        for own, (y, z) in zip(codes, spans, strict=True):
            own.append(answer[x : x + z - y].tobytes())
            x += z - y
    split = np.flatnonzero(part_of >= 0)
    one = (part_of < 0) & (names != _START_CONTEXT)
    seen = [int((one & (total > 0)).sum()), int((one & (total == 1)).sum()), int((one & (total == 2)).sum())]
    n = len(rows)
    fields = [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array(np.full(n, cell)),
        pa.array([b"".join(c) for c in codes], pa.binary()),
        pa.array([total[a].tobytes() for a in at], pa.binary()),
        pa.array([types[a].astype(np.uint32).tobytes() for a in at], pa.binary()),
        pa.array([seen] + [None] * (n - 1), pa.list_(pa.int64())),
        pa.array([words[part_of[split]].tolist()] + [None] * (n - 1), pa.list_(pa.int64())),
        pa.array([types[split].tolist()] + [None] * (n - 1), pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(fields, names=[f.split()[0] for f in ANSWER_FIELDS.split(", ")])


def _answer_range(names: np.ndarray, of: np.ndarray, successors: bytes, counts: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of each bigram (place of its context, successor); count and types of each context.

    whole: of contexts that are parts, the count of the context that was split; 0 of others.
    """
    wide = np.zeros((len(of), 8), np.uint8)
    wide[:, : Trie.BITS // 8] = np.frombuffer(successors, np.uint8).reshape(-1, Trie.BITS // 8)
    keys = wide.view("<i8").ravel()
    keys |= of.astype(np.int64) << Trie.BITS
    asked, entry = np.unique(keys, return_inverse=True)
    del wide, keys
    entry = entry.astype(np.int32)  # a cell has no more entries than its blocks have tokens
    sums = np.bincount(entry, weights=counts, minlength=len(asked)).astype(np.int64)
    known = sums > 0
    keys, sums = asked[known], sums[known]
    of = keys >> Trie.BITS
    total = np.bincount(of, weights=sums, minlength=len(names)).astype(np.int64)
    types = np.bincount(of, minlength=len(names))
    trie = Trie.build(names, keys, quantised((sums - DISCOUNT) / np.where(whole > 0, whole, total)[of]))
    # the trie is asked once for each bigram of the range, whatever the number of blocks that ask, some at a time
    del keys, sums, of, known
    codes, places = np.empty(len(asked), np.uint8), trie.places(names)
    for a in range(0, len(asked), ASKED):
        some = asked[a : a + ASKED]
        codes[a : a + ASKED] = trie.codes_after(places[some >> Trie.BITS], some & ((1 << Trie.BITS) - 1))
    return codes[entry], total, types


with np.errstate(over="ignore"):
    _START_CONTEXT = int(spread(np.array([START]))[0] >> np.uint64(1))


# ------------------------------------------------------------------ hot contexts


def _cell_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            words, n = _train_words(batch, i)
            counts += np.bincount((words >> np.uint64(48)).astype(np.int64), weights=n, minlength=CELLS).astype(np.int64)
    cells = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], names=["cell", "n"])


def _train_words(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of a block and how often they are contexts in training texts (START too)."""
    block = _Block(batch, i)
    n = np.bincount(block.tokens[np.repeat(~block.held, block.sizes)], minlength=len(block.words))
    n[block.words == END] = 0  # an end is no context
    return np.r_[block.words, START], np.r_[n, (~block.held).sum()]


def _hot_candidates(batches: Iterable[pa.RecordBatch], full) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            words, n = _train_words(batch, i)
            may = full.value[(words >> np.uint64(48)).astype(np.int64)] & (n > 0)
            yield pa.RecordBatch.from_arrays([pa.array(words[may].view(np.int64)), pa.array(n[may])], names=["word", "n"])


def hot_contexts(blocks: DataFrame) -> dict[int, int]:
    """Words that are contexts of more than HOT training tokens, with that number: at most N / HOT of them."""
    blocks = blocks.select("words", "tokens", "held", "sizes")
    found = per_task(blocks, _cell_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > HOT).select("cell").collect()
    if not found:
        return {}
    full = np.zeros(CELLS, bool)
    full[[r[0] for r in found]] = True
    told = blocks.sparkSession.sparkContext.broadcast(full)
    words = per_task(blocks, _hot_candidates, "word long, n long", told).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > HOT).collect()
    return {r[0]: r[1] for r in words}


# ------------------------------------------------------------------ scores

SCORE_FIELDS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(batches: Iterable[pa.RecordBatch], hot, model: dict) -> Iterator[pa.RecordBatch]:
    for block, *answers in _answered(batches):
        yield _scored(block, *map(b"".join, answers), hot.value, model)


def _answered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Each block (a row without a cell) with the codes, totals and types of the rows that follow it, its cells' answers in order."""
    block, found = None, ([], [], [])
    for batch in batches:
        heads = np.flatnonzero(batch.column("cell").is_null().to_numpy(zero_copy_only=False)).tolist()
        for a, b in zip([0, *heads], [*heads, batch.num_rows], strict=True):
            if a in heads and a < b:
                if block:
                    yield block, *found
                block, found = _Block(batch, a), ([], [], [])
                a += 1
            for own, name in zip(found, ("codes", "totals", "types"), strict=True):
                own += batch.column(name).slice(a, b - a).to_pylist()
    if block:
        yield block, *found


def _scored(block: _Block, codes: bytes, totals: bytes, types: bytes, hot: tuple[np.ndarray, ...], model: dict) -> pa.RecordBatch:
    names, parts, hot_totals, hot_types = hot
    n, v, d1, ends = model["n"], model["v"], model["d1"], model["ends"]
    own = _Bigrams(block, (names, parts))
    codes, totals, types = np.frombuffer(codes, np.uint8), np.frombuffer(totals, np.int64), np.frombuffer(types, np.uint32)
    if len(codes) != len(own.keys) or len(totals) != len(own.contexts):
        raise ValueError("a block without all of its answers")
    with np.errstate(over="ignore"):
        at = np.searchsorted(own.contexts, (spread(block.words) >> np.uint64(1)).view(np.int64))
    at[at == len(own.contexts)] = 0
    count = totals[at]  # of each word of the block: its count as a context
    count[block.words == END] = ends
    place = own.keys[own.entry] >> Trie.BITS
    c_before, t_before = totals[place].astype(float), types[place].astype(float)
    del at, place
    if len(names):
        k = np.searchsorted(names, block.words)
        k[k == len(names)] = 0
        is_hot = names[k] == block.words
        count[is_hot] = hot_totals[k[is_hot]]
        before = own.before()
        k = np.searchsorted(names, before)
        k[k == len(names)] = 0
        is_hot = names[k] == before
        c_before[is_hot], t_before[is_hot] = hot_totals[k[is_hot]], hot_types[k[is_hot]]
        del before, k, is_hot
    base = np.log10((count + 1) / (n + v + 1))
    single = np.where(count > 0, (count - d1) / max(n, 1), d1 * v / n if n else 1.0)
    p = np.where(c_before > 0, DISCOUNT * t_before / np.maximum(c_before, 1), 1.0)  # what is left to the unigram model
    del c_before, t_before
    p *= single[block.tokens]
    p += VALUES[codes[own.entry]]
    first = np.cumsum(block.sizes) - block.sizes
    columns = [
        block.doc_ids,
        pa.array(block.held),
        pa.array(block.sizes),
        pa.array(np.add.reduceat((count > 0)[block.tokens].astype(np.int64), first)),
        pa.array(np.full(len(first), n)),
        pa.array(np.add.reduceat(base[block.tokens], first)),
        pa.array(np.add.reduceat(np.log10(p), first)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCORE_FIELDS.split(", ")])


def score(df: DataFrame) -> DataFrame:
    """SCORE_FIELDS of each document of ``df`` (doc_id, text)."""
    spark = df.sparkSession
    bounded_batches(spark)  # blocks and answers are wide rows
    sc = spark.sparkContext
    n_parts = partitions_of(spark)
    blocks = stored(per_task(df.select("doc_id", text_bytes().alias("text")), _blocks, BLOCK_FIELDS), "lm-blocks", 1)
    told = blocks.agg(F.sum("train_tokens"), F.sum("train_docs"), F.sum("n_tokens")).first()
    n, ends, everything = (int(x or 0) for x in told)
    found = hot_contexts(blocks)
    names = np.array(sorted(np.array(list(found), np.int64).view(np.uint64).tolist()), np.uint64)
    totals = np.array([found[int(x)] for x in names.view(np.int64)], np.int64)
    parts = (totals // CELL + 1).astype(np.uint64)
    n_cells = min(1 << 31, everything // CELL + 1)
    asked = per_task(blocks, _requests, REQUEST_FIELDS, n_cells, sc.broadcast((names, parts)))
    asked = asked.repartition(n_parts, "cell").sortWithinPartitions("cell", "block")
    answers = stored(per_task(asked, _answers, ANSWER_FIELDS, sc.broadcast((names.view(np.int64), totals))), "lm-answers", ANSWERS)
    del asked
    seen = answers.where("seen is not null")
    v, n1, n2 = (int(x or 0) for x in seen.agg(*(F.sum(F.col("seen")[k]) for k in range(3))).first())
    parts_of = seen.select(F.explode(F.arrays_zip("hot", "hot_types")).alias("x")).groupBy("x.hot").agg(F.sum("x.hot_types").alias("types")).collect()
    hot_types = {r[0]: r[1] for r in parts_of}
    v += sum(x != int(START.astype(np.int64)) for x in names.view(np.int64).tolist()) + (ends > 0)
    model = {"n": n, "v": v, "d1": n1 / (n1 + 2 * n2) if n1 and n2 else 0.5, "ends": ends}
    told_hot = sc.broadcast((names, parts, totals, np.array([hot_types.get(int(x), 0) for x in names.view(np.int64)], np.int64)))
    drop_shuffles(spark)  # of the requests, before blocks and answers are shuffled
    # a block's row has no cell, so it comes before its answers
    stream = blocks.select("block", "doc_ids", "held", "sizes", "words", "tokens").unionByName(answers.select("block", "cell", "codes", "totals", "types"), allowMissingColumns=True)
    stream = stream.repartition(n_parts, "block").sortWithinPartitions("block", F.asc_nulls_first("cell"))
    return per_task(stream, _scores, SCORE_FIELDS, told_hot, model)
