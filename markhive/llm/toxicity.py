"""Toxicity scores of texts restored by a noisy-channel decoder.

Restoring.  A word that may be disguised (digits or symbols among letters or at
an edge, a letter three times in a row, letters set apart by spaces) opens a
lattice: each character may stand for itself, for the letters it is often
written for, or for nothing; a repeated character may be dropped.  Viterbi
decoding takes the path that is likeliest under a character trigram model
(counted over all documents) and the channel's costs.  All other words are their
own only path.  A word that ends in symbols is also read without them, since
they may as well be punctuation; numbers without a symbol stay numbers.

Scoring.  Features are the restored words and their character n-grams, hashed
to BINS counters.  How many toxic and clean training documents hold a feature is
counted over all labelled training rows; features that speak for a label at a
significance of SIGNIFICANT go into a logistic regression, fitted on at most
SAMPLE_ROWS labelled rows (the documented bound) chosen by a hash of their ids.

Cases: null and empty texts have no features and get the base score; without
labels of both kinds every score is the share of toxic labels (0 without any).
A document with several labels is toxic if one of them says so.  Whole texts
are scored.  Labels, language, source and ids are no inputs of a score.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markhive.llm.common import as_text, keep_between_tasks, partitions_of, per_task, pieces, text_bytes, with_field
from markhive.llm.idfilter import id_filter, maybe_in
from markhive.llm.word_hash import spread

#: Labelled rows that the regression is fitted on.
SAMPLE_ROWS = 20_000
#: Counters of hashed features, and length of the n-grams.
BINS, GRAM = 1 << 21, 5
#: Counters that leave a task together.
CHUNK = 1 << 13
#: z-value from which a feature is used, and training documents of the label that hold it.
SIGNIFICANT, LEAST_DOCS = 4.0, 3
#: Letters of the character model; the others count as one.
LETTERS = 60
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Features of the rows that the fit goes through together.
FIT_BLOCK = 1 << 20
#: Bytes of words that a worker remembers (about: their characters and what their tables take), before it starts afresh.
REMEMBERED_BYTES = 64 << 20
ENTRY_BYTES = 180

#: What a character is often written for (fixed values).
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "§": "s", "¡": "i", "µ": "u",
}
#: Channel costs in nats: written for another letter, symbol for nothing, digit for nothing, letter for nothing,
#: repeated character dropped from a pair, and from three or more.
COSTS = {"stands": 1.0, "noise": 0.5, "digit": 8.0, "lost": 25.0, "pair": 6.0, "repeat": 0.5}

#: Characters besides digits that stand for letters.
SIGNS = "".join(c for c in STANDS_FOR if not c.isdigit())

_repeated = re.compile(r"(.)\1\1")
_tails = re.compile(rf"[^\w\s{re.escape(SIGNS)}]+(?=\s|$)")  # trailing symbols that stand for no letter
_symbols = re.compile(r"[^\w\s]+$")
_edges = re.compile(r"^[\W_]+|[\W_]+$")
_signs = re.compile(f"[{re.escape(SIGNS)}]")
_single = re.compile(r".[^\w\s]*")


@dataclass
class CharModel:
    """Character trigrams with additive smoothing; 0 is the edge of a word, 1 any other character."""

    number: dict[str, int]
    logs: np.ndarray  # [before last, last, next]
    known: dict[str, str] = field(default_factory=dict)
    held: int = 0
    flat: list[float] = field(default_factory=list)  # logs as plain numbers, once asked for

    def code(self, c: str) -> int:
        return self.number.get(c, 1)

    def forget(self) -> None:
        self.known.clear()
        self.held = 0

    def restore(self, word: str) -> str:
        """The likeliest spelling of one lower-case word."""
        found = self.known.get(word)
        if found is None:
            if self.held > REMEMBERED_BYTES:
                self.forget()
            found = self.known[word] = self._viterbi(word)
            self.held += ENTRY_BYTES + 4 * len(word)
        return found

    def _viterbi(self, word: str) -> str:
        if not self.flat:
            self.flat.extend(self.logs.ravel().tolist())
        logs, size = self.flat, len(self.logs)
        # a state's past counts for the next two logs only: what lies further behind the best can't win
        met = sorted({0, *(self.code(x) for c in set(word) for x in (c, *STANDS_FOR.get(c, "")))})
        own = self.logs[np.ix_(met, met, met)]
        behind = 2 * float(own.max() - own.min()) + 1e-6
        tripled = {c for c in set(word) if c * 3 in word}
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for i, c in enumerate(word):
            moves = [(c, 0.0)] if c.isalpha() else []
            moves += [(x, COSTS["stands"]) for x in STANDS_FOR.get(c, "")]
            skip = COSTS["lost"] if c.isalpha() else COSTS["digit"] if c.isalnum() else COSTS["noise"]
            if i and c == word[i - 1]:
                skip = min(skip, COSTS["repeat" if c in tripled else "pair"])
            if not moves:
                moves = [(c, COSTS["lost"])]
            coded = [(x, self.code(x), cost) for x, cost in moves]
            least = max(s for s, _ in states.values()) - behind
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, path) in states.items():
                if score < least:
                    continue
                if (a, b) not in after or after[a, b][0] < score - skip:
                    after[a, b] = (score - skip, path)
                at = (a * size + b) * size
                for x, k, cost in coded:
                    reached = score - cost + logs[at + k]
                    if (b, k) not in after or after[b, k][0] < reached:
                        after[b, k] = (reached, (path, x))
            states = after
        best = max(states.items(), key=lambda s: s[1][0] + logs[(s[0][0] * size + s[0][1]) * size])
        letters, path = [], best[1][1]
        while path:
            path, x = path
            letters.append(x)
        return "".join(reversed(letters))

    def restored(self, token: str) -> set[str]:
        """What a lower-case token may mean: its word, and the word restored if it may be disguised."""
        if token.isascii() and token.isalnum():
            return self._bare(token)
        out = self._bare(_symbols.sub("", token))
        if _signs.search(token):
            out.add(self.restore(token))
        return out - {""}

    def _bare(self, token: str) -> set[str]:
        core = token if token.isalpha() else _edges.sub("", token)
        if core.isalpha() and not _repeated.search(core):
            return {core}
        if any(map(str.isalpha, token)):
            return {self.restore(token), core} - {""}
        return set()

    def words(self, text: str) -> set[str]:
        """The text's distinct words, restored."""
        split = _tails.sub("", text.lower()).split()
        out = set().union(*map(self.restored, set(split)))
        return (out | {self.restore(run) for run in _single_runs(split)}) - {""}


def _single_runs(split: list[str]) -> set[str]:
    """Three and more single characters in a row, joined.

    Symbols that stand for letters may follow them or stand alone: such a run is
    joined with its symbols and without those that end a token.
    """
    single = np.fromiter(map(len, split), np.int64, len(split)) == 1
    if signed := {w for w in set(split) if w[-1] in SIGNS and _single.fullmatch(w)}:
        single |= np.fromiter(map(signed.__contains__, split), bool, len(split))
    out = set()
    if not (single[:-2] & single[1:-1] & single[2:]).any():
        return out
    run: list[str] = []
    for w, one in zip([*split, ""], [*single.tolist(), False], strict=True):
        if one:
            run.append(w)
        elif run:
            bare = [c for c in (_symbols.sub("", w) for w in run) if c]
            out.update("".join(x) for x in (run, bare) if len(x) > 2)
            run = []
    return out


# ------------------------------------------------------------------ the character model


def _points(texts: list[bytes]) -> np.ndarray:
    """Code points of the lower-cased texts, set apart by line feeds."""
    return np.frombuffer("\n".join(as_text(x) for x in texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _letters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0x110000, np.int64)
    for batch in pieces(batches):
        counts += np.bincount(_points(batch.column("text").to_pylist()), minlength=0x110000)
    found = {chr(c): int(counts[c]) for c in np.flatnonzero(counts) if chr(c).isalpha()}
    yield pa.RecordBatch.from_pydict({"letter": list(found), "n": list(found.values())}, schema=pa.schema({"letter": pa.string(), "n": pa.int64()}))


def _trigrams(batches: Iterable[pa.RecordBatch], number: dict[str, int], size: int) -> Iterator[pa.RecordBatch]:
    """Trigrams of all runs of letters, with two edges before and one after each."""
    code = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.int64, 0x110000)
    for letter, k in number.items():
        code[ord(letter)] = k
    counts = np.zeros(size**3, np.int64)
    for batch in pieces(batches):
        codes = code[_points(batch.column("text").to_pylist())]
        inside = codes > 0
        starts = inside & ~np.r_[False, inside[:-1]]
        run = np.cumsum(starts)[inside]
        spaced = np.zeros(int(inside.sum()) + 2 * int(starts.sum()) + 1, np.int64)
        spaced[np.arange(len(run)) + 2 * run] = codes[inside]
        a, b, c = spaced[:-2], spaced[1:-1], spaced[2:]
        whole = (a == 0) | (b > 0)
        counts += np.bincount(((a * size + b) * size + c)[whole & ((b > 0) | (c > 0))], minlength=size**3)
    cells = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], names=["cell", "n"])


def char_model(df: DataFrame) -> CharModel:
    """Trigram counts over all texts; at most (LETTERS + 2) ** 3 of them reach the driver."""
    texts = df.select(text_bytes().alias("text"))
    letters = per_task(texts, _letters, "letter string, n long").groupBy("letter").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "letter").limit(LETTERS).collect()
    number = {r["letter"]: k + 2 for k, r in enumerate(letters)}
    size = LETTERS + 2
    counts = np.zeros(size**3)
    for cell, n in per_task(texts, _trigrams, "cell long, n long", number, size).groupBy("cell").agg(F.sum("n")).toArrow().to_pandas().itertuples(index=False):
        counts[cell] = n
    counts = counts.reshape(size, size, size)
    pairs = counts.sum(axis=0) + 0.1
    back = pairs / pairs.sum(axis=1, keepdims=True)
    logs = np.log((counts + 2.0 * back[None]) / (counts.sum(axis=2, keepdims=True) + 2.0))
    return CharModel(number, logs.astype(np.float32))


# ------------------------------------------------------------------ features


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Place of the word and bin of each feature: the words themselves, and their n-grams with edges."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(points)) - first[word]
    with np.errstate(over="ignore"):
        powers = np.full(int(lengths.max()), STEP, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        whole = spread(np.add.reduceat(points * powers[at], first) + lengths.astype(np.uint64) * STEP)
        n = max(0, len(points) - GRAM + 1)
        inside = at[:n] + GRAM <= lengths[word[:n]]
        grams = sum((points[k : n + k] * powers[min(k, len(powers) - 1)] for k in range(GRAM)), np.zeros(n, np.uint64))
        grams = spread(grams[inside] ^ STEP)
    return np.r_[np.arange(len(words)), word[:n][inside]], (np.r_[whole, grams] % np.uint64(BINS)).astype(np.int64)


class _Known:
    """Features of tokens, computed for many at once and remembered.

    ``keep`` maps a bin to the number that stands for it, or to -1 for features that don't count.
    """

    def __init__(self, model: CharModel, keep: np.ndarray | None = None):
        self.model, self.keep = model, keep
        self.place = np.zeros(BINS if keep is None else max(1, int(keep.max(initial=0)) + 1), np.int32)
        keep_between_tasks(__name__, model.forget)
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.held = 0
        self.flat, self.off = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.telling: set[str] = set()  # tokens that have features that count

    def _learn(self, tokens: list[str]) -> None:
        pairs = [(k, w) for k, t in enumerate(tokens) for w in self.model.restored(t)]
        own, value = np.empty(0, np.int64), np.empty(0, np.int64)
        if pairs:
            place, value = word_features([w for _, w in pairs])
            own = np.array([k for k, _ in pairs])[place]
        if self.keep is not None:
            value = self.keep[value]
            own, value = own[value >= 0], value[value >= 0]
        sizes = np.bincount(own, minlength=len(tokens))
        self.telling.update(tokens[k] for k in np.flatnonzero(sizes))
        self.seen.update(zip(tokens, range(len(self.seen), len(self.seen) + len(tokens)), strict=True))
        self.held += ENTRY_BYTES * len(tokens) + 2 * sum(map(len, tokens)) + 4 * len(value)
        self.off = np.r_[self.off, self.off[-1] + np.cumsum(sizes)]
        self.flat = np.r_[self.flat, value[np.argsort(own, kind="stable")].astype(np.int32)]

    def features(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Distinct features of each text."""
        if self.held > REMEMBERED_BYTES:
            self._forget()
        split = []
        for text in texts:
            tokens = _tails.sub("", text.lower()).split()
            split.append(set(tokens) | _single_runs(tokens))
        if fresh := set().union(*split).difference(self.seen):
            self._learn(list(fresh))
        for tokens in split:
            tokens &= self.telling
            at = np.fromiter(map(self.seen.__getitem__, tokens), np.int64, len(tokens))
            first, size = self.off[at], self.off[at + 1] - self.off[at]
            ends = np.cumsum(size)
            found = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)]
            # of each feature the last one that was written to its place
            number = np.arange(len(found), dtype=np.int32)
            self.place[found] = number
            yield found[self.place[found] == number]


def _counted(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """For each bin the toxic and clean documents that hold it."""
    known, counts = _Known(model.value), np.zeros((2, BINS), np.int32)
    for batch in pieces(batches):
        texts = [as_text(raw) for raw in batch.column("text").to_pylist()]
        for bins, toxic in zip(known.features(texts), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic, bins] += 1
    for c in range(0, BINS, CHUNK):
        own = counts[:, c : c + CHUNK]
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names=["chunk", "counts"])


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each chunk's counters, from rows sorted by chunk: bins that enough documents hold."""
    chunk, sums = None, np.zeros((2, CHUNK), np.int64)

    def told() -> pa.RecordBatch:
        at = np.flatnonzero((sums >= LEAST_DOCS).any(axis=0))
        return pa.RecordBatch.from_arrays([pa.array(chunk + at), pa.array(sums[1, at]), pa.array(sums[0, at])], names=["bin", "t", "c"])

    for batch in batches:
        for c, packed in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            if c != chunk:
                if chunk is not None:
                    yield told()
                chunk, sums = c, np.zeros((2, CHUNK), np.int64)
            sums += np.frombuffer(zlib.decompress(packed), np.int32).reshape(2, CHUNK)
    if chunk is not None:
        yield told()


def _selected(model: CharModel, place: dict[int, int]) -> _Known:
    """Only selected features, by their places."""
    keep = np.full(BINS, -1, np.int32)
    keep[list(place)] = list(place.values())
    return _Known(model, keep)


def _held(batches: Iterable[pa.RecordBatch], model, place) -> Iterator[pa.RecordBatch]:
    known = _selected(model.value, place.value)
    for batch in pieces(batches):
        held = list(known.features([as_text(raw) for raw in batch.column("text").to_pylist()]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held, pa.list_(pa.int32()))], names=["doc_id", "held"])


def fitted(row: np.ndarray, column: np.ndarray, labels: np.ndarray, size: int, rounds: int = 300, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on present features (row, column), rows ascending: weights and intercept (full gradients with momentum).

    The rows are gone through in blocks, so that memory follows ``column``.
    """
    n = len(labels)
    sizes = np.bincount(row, minlength=n)
    ends = np.cumsum(sizes)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(FIT_BLOCK, ends[-1] if n else 0, FIT_BLOCK)) + 1, n])
    blocks = []
    for a, b in itertools.pairwise(cuts.tolist()):
        own, of = column[(ends[a] - sizes[a]) : ends[b - 1]], sizes[a:b]
        some = np.flatnonzero(of)  # rows with features, and where theirs begin
        order = np.argsort(own, kind="stable")
        kinds, first = np.unique(own[order], return_index=True)
        blocks.append((a, b, own, some, (np.cumsum(of) - of)[some], np.repeat(np.arange(b - a, dtype=np.int32), of)[order], kinds, first))
    often = np.maximum(1.0, np.bincount(column, minlength=size))
    rate = n / np.sqrt(often * n) / max(1.0, float(sizes.mean()) ** 0.5)
    w, base = np.zeros(size), float(np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5)))
    speed, speed_base = np.zeros(size), 0.0
    for _ in range(rounds):
        grad, gaps = ridge * w, 0.0
        for a, b, own, some, starts, rows, kinds, first in blocks:
            z = np.full(b - a, base)
            if len(some):
                z[some] += np.add.reduceat(w[own], starts)
            gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[a:b]
            if len(kinds):
                grad[kinds] += np.add.reduceat(gap[rows], first) / n
            gaps += gap.sum()
        speed = 0.9 * speed - rate * grad
        speed_base = 0.9 * speed_base - 0.5 * gaps / n
        w, base = w + speed, base + speed_base
    return w, base


@dataclass
class Scorer:
    chars: CharModel
    place: dict[int, int]
    weights: np.ndarray
    base: float


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(df: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """The scorer for ``df`` (doc_id, text), from ``labels`` (doc_id, toxic) that are not held out."""
    spark = df.sparkSession
    sc = spark.sparkContext
    chars = char_model(df)
    told = sc.broadcast(chars)
    known = labels.where("doc_id is not null and toxic is not null").where(~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = df.select("doc_id", text_bytes().alias("text"))
    # only labelled texts are shuffled
    trained = maybe_in(texts, "doc_id", id_filter(known.select("doc_id"))).join(known, "doc_id")
    totals = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        share = n1 / max(1, n1 + n0)
        return Scorer(chars, {}, np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    packed = per_task(trained.select("text", "toxic"), _counted, "chunk long, counts binary", told)
    packed = packed.repartition(partitions_of(spark), "chunk").sortWithinPartitions("chunk")
    counts = per_task(packed, _summed, "bin long, t long, c long")
    # only bins that speak for a label reach the driver
    p = (F.col("t") + F.col("c")) / F.lit(float(n1 + n0))
    error = F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n1 + 1 / n0))
    z = (F.col("t") / F.lit(float(n1)) - F.col("c") / F.lit(float(n0))) / error
    enough = F.when(z > 0, F.col("t")).otherwise(F.col("c")) >= LEAST_DOCS
    bins = sorted(r[0] for r in counts.where((F.abs(z) >= SIGNIFICANT) & enough).select("bin").collect())
    place = {b: k for k, b in enumerate(bins)}
    # a bounded sample of labelled rows, chosen by a hash
    rows = known.orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(sample_rows).toArrow().to_pandas()
    picked = spark.createDataFrame(rows[["doc_id"]], "doc_id long")
    some = per_task(maybe_in(texts, "doc_id", id_filter(picked)), _held, "doc_id long, held array<int>", told, sc.broadcast(place)).toArrow()
    toxic = rows.set_index("doc_id")["toxic"].reindex(some.column("doc_id").to_pandas()).to_numpy(float)
    inside = ~np.isnan(toxic)  # the filter may let other documents through
    held = some.column("held").combine_chunks().filter(pa.array(inside))
    row = np.repeat(np.arange(len(held), dtype=np.int32), pc.list_value_length(held).to_numpy())
    weights, base = fitted(row, held.flatten().to_numpy(), toxic[inside], len(place))
    return Scorer(chars, place, weights, base)


def _scored(batches: Iterable[pa.RecordBatch], scorer, column: str, name: str) -> Iterator[pa.RecordBatch]:
    own = scorer.value
    known = _selected(own.chars, own.place)
    for batch in pieces(batches, column):
        texts = [as_text(raw) for raw in batch.column(column).to_pylist()]
        z = own.base + np.array([own.weights[held].sum() for held in known.features(texts)])
        scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        rest = [(n, batch.column(n)) for n in batch.schema.names if n != column]
        yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(scores, pa.float64())], names=[n for n, _ in rest] + [name])


def score(df: DataFrame, scorer: Scorer, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``df`` with the score (0 to 1) of ``text``."""
    if name in df.columns:
        raise ValueError(f"column {name} exists; name another one")
    raw = "__text"
    while raw in df.columns:
        raw = "_" + raw
    told = df.sparkSession.sparkContext.broadcast(scorer)
    return per_task(df.withColumn(raw, text_bytes(f"`{text}`")), _scored, with_field(df.schema, name, "double"), told, raw, name)


#: Score from which a document is toxic.
TOXIC = 0.7


def _query_rows(batches: Iterable[pa.RecordBatch], scorer) -> Iterator[pa.RecordBatch]:
    return _scored(batches, scorer, "text", "score")


def judged(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    told = df.sparkSession.sparkContext.broadcast(learn(df, labels))
    scored = per_task(df.select("doc_id", text_bytes().alias("text")), _query_rows, "doc_id long, score double", told)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def without_toxic(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below TOXIC, with their columns."""
    name = "toxicity"
    while name in df.columns:
        name = "_" + name
    return score(df, learn(df, labels), name=name).where(F.col(name) < TOXIC).drop(name)
