"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The symbols of many words lie in one flat array.  A round looks up the rank of
every neighbouring pair, takes the smallest rank of each word (segmented
minimum) and merges its leftmost occurrence in all words at once; words without
a mergeable pair leave the arrays.  Rounds go on until no pair remains.

One merge per word and round keeps the library's order exactly: there a merged
piece may rank before the pair it came from, so that two equal pairs of a word
may not always be merged together.  Words of more than LONG symbols (text
without spaces) follow the same order with a heap, which takes n log n steps
instead of n rounds over n symbols.

Cases: null and empty texts have no ids and decode to ''.  Characters outside
the vocabulary become byte pieces.  Other columns stay as they are.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from markhive.llm.common import as_text, keep_between_tasks, per_task, pieces, text_bytes, with_field

#: Words of more symbols are merged with a heap.
LONG = 256
#: Bytes of words that a worker remembers (about: their characters and ids, and what their tables take), before it starts afresh.
REMEMBERED_BYTES = 80 << 20
ENTRY_BYTES = 180
SPACE = "▁"
NO_PAIR = np.int32(np.iinfo(np.int32).max)


class PieceCodec:
    """Encoder and decoder for one BPE model with byte fallback."""

    def __init__(self, model_path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.control = np.array([model.is_control(i) for i in range(size)])
        self.unknown = np.array([model.is_unknown(i) for i in range(size)])
        self.byte = np.array([model.is_byte(i) for i in range(size)])
        normal = np.flatnonzero(~(self.control | self.unknown | self.byte))
        self.of_byte = {int(self.pieces[i][1:-1], 16): int(i) for i in np.flatnonzero(self.byte)}
        if len(self.of_byte) != 256:
            raise ValueError("a model with byte fallback is needed")
        ids = {self.pieces[i]: int(i) for i in normal}
        scores = np.array([model.get_score(int(i)) for i in normal])
        order = np.unique(-scores, return_inverse=True)[1]
        rank = dict(zip(normal.tolist(), order.tolist(), strict=True))
        # single characters: their own ids, or ids above the vocabulary
        self.symbol = {c: i for c, i in ids.items() if len(c) == 1}
        for piece in ids:
            for c in piece:
                if c not in self.symbol:
                    self.symbol[c] = size + len(self.symbol)
        lookup = self.symbol | ids
        keys, ranks, merged = [], [], []
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = lookup.get(piece[:cut]), lookup.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(rank[i])
                    merged.append(i)
        at = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[at]
        self.ranks = np.array(ranks, np.int32)[at]
        self.merged = np.array(merged, np.int32)[at]
        self.pair = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))
        # what is never inside a longer piece can be cut off before merging
        inner = {c for p in ids if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            self.words = re.compile("(?s).+")
        elif "\n" in inner:
            self.words = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        else:
            self.words = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        self.surface = [self._surface(i) for i in range(size)]
        self.prefixed = [not (self.byte[i] or self.control[i] or self.unknown[i]) and self.pieces[i].startswith(SPACE) for i in range(size)]
        self.special = {int(i) for i in np.flatnonzero(self.control)}
        self._forget()

    def _surface(self, i: int) -> bytes:
        if self.byte[i]:
            return bytes([int(self.pieces[i][1:-1], 16)])
        if self.control[i]:
            return b""
        if self.unknown[i]:
            return " ⁇ ".encode()
        return self.pieces[i].replace(SPACE, " ").encode()

    # ------------------------------------------------------------ encoding

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.held = 0
        self.flat = np.empty(1 << 16, np.int32)
        self.used = 0
        self.off = np.zeros(1, np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; NO_PAIR where they don't merge."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR)

    def _merge_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words after all merges, one word after the other, and each word's number of them."""
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        joined = "".join(words)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        uniq, inverse = np.unique(points, return_inverse=True)
        table = np.array([self.symbol.get(chr(c), -1 - int(c)) for c in uniq], np.int64)
        sym = table[inverse]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        last = np.zeros(len(sym), bool)
        last[np.cumsum(lengths) - 1] = True
        # characters outside the vocabulary have negative numbers: never in a pair
        rank = np.full(len(sym), NO_PAIR, np.int32)
        inside = ~last[:-1] & (sym[:-1] >= 0) & (sym[1:] >= 0)
        rank[:-1][inside] = self._rank(sym[:-1][inside], sym[1:][inside])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            done = best == NO_PAIR
            if done.any():  # compaction: finished words leave
                keep = np.repeat(~done, sizes)
                finished.append((word[~keep], sym[~keep]))
                sym, word, rank, last = sym[keep], word[keep], rank[keep], last[keep]
                best, sizes = best[~done], sizes[~done]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            hit = hit[np.r_[True, word[hit[1:]] != word[hit[:-1]]]]  # leftmost of each word
            key = sym[hit] << 32 | sym[hit + 1]
            sym[hit] = self.merged[np.searchsorted(self.keys, key)]
            last[hit] = last[hit + 1]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word, rank, last = sym[keep], word[keep], rank[keep], last[keep]
            hit -= np.arange(len(hit))  # one symbol went before each later hit
            for at in (hit, hit[hit > 0] - 1):
                rank[at] = NO_PAIR
                at = at[~last[at]]
                at = at[(sym[at] >= 0) & (sym[at + 1] >= 0)]
                rank[at] = self._rank(sym[at], sym[at + 1])
        word, sym = (np.concatenate(x) for x in zip(*finished, strict=True))
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _merge_long(self, word: str) -> np.ndarray:
        """The same merges for one long word, taken from a heap."""
        sym = [self.symbol.get(c, -1 - ord(c)) for c in word]
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (found := self.pair.get(sym[i] << 32 | sym[j])):
                heapq.heappush(heap, (found[0], i, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i] = self.pair[a << 32 | b][1]
            alive[j] = False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([s for s, live in zip(sym, alive, strict=True) if live], np.int64)

    def _to_ids(self, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary ids of symbols; characters without one become byte pieces."""
        odd = np.flatnonzero((sym < 0) | (sym >= len(self.pieces)))
        if not len(odd):
            return sym, sizes
        kinds, kind = np.unique(sym[odd], return_inverse=True)
        spelled = {v: k for k, v in self.symbol.items() if v >= len(self.pieces)}
        spelled = [[self.of_byte[b] for b in (chr(-1 - s) if s < 0 else spelled[s]).encode("utf-8", "surrogatepass")] for s in kinds.tolist()]
        count = np.ones(len(sym), np.int64)
        count[odd] = np.array([len(x) for x in spelled])[kind]
        ends = np.cumsum(count)
        out = np.repeat(sym, count)
        for k in range(4):
            some = odd[count[odd] > k]
            out[ends[some] - count[some] + k] = [spelled[x][k] for x in kind[count[odd] > k].tolist()]
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]]
        return out, np.diff(bounds)

    def _learn(self, words: list[str]) -> None:
        """Encodes words not seen yet and remembers them."""
        words = sorted(words, key=lambda w: len(w) > LONG)
        short = [w for w in words if len(w) <= LONG]
        sym, sizes = self._merge_rounds(short) if short else (np.empty(0, np.int64), np.empty(0, np.int64))
        if long := [self._merge_long(w) for w in words[len(short) :]]:
            sym, sizes = np.concatenate([sym, *long]), np.r_[sizes, [len(x) for x in long]]
        sym, sizes = self._to_ids(sym, sizes)
        self.seen.update(zip(words, range(len(self.seen), len(self.seen) + len(words)), strict=True))
        self.held += ENTRY_BYTES * len(words) + 2 * sum(map(len, words)) + 4 * len(sym)
        self.off = np.concatenate([self.off, self.used + np.cumsum(sizes)])
        need = self.used + len(sym)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(need, 2 * len(self.flat)) - self.used, np.int32)])
        self.flat[self.used : need] = sym
        self.used = need

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them without begin and end ids."""
        if self.held > REMEMBERED_BYTES:
            self._forget()
        split = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        words = list(itertools.chain.from_iterable(split))
        if fresh := set(words).difference(self.seen):
            self._learn(list(fresh))
        at = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        first = self.off[at]
        size = self.off[at + 1] - first
        ends = np.cumsum(size)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)]
        bounds = np.r_[0, ends][np.cumsum(list(map(len, split)))[:-1]] if len(split) > 1 else []
        return np.split(ids, bounds) if split else []

    # ------------------------------------------------------------ decoding

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, as the library's decode(ids) gives it."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        first = 0
        while first < len(ids) and ids[first] in self.special:
            first += 1
        if not self.special.isdisjoint(ids):
            return self._decode_bytes(ids, first)
        raw = b"".join(map(self.surface.__getitem__, ids))
        if first < len(ids) and self.prefixed[ids[first]]:
            raw = raw[1:]  # the space that encoding puts before a text
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return self._decode_bytes(ids, first)

    def _decode_bytes(self, ids: list[int], first: int) -> str:
        """As decode, where byte pieces are not valid UTF-8: U+FFFD for each byte left over."""
        out, run = [], b""
        for k, i in enumerate([*ids, -1]):
            if i >= 0 and self.byte[i]:
                run += self.surface[i]
                continue
            while run:
                n = 1 if run[0] < 0xC0 else 2 if run[0] < 0xE0 else 3 if run[0] < 0xF0 else 4
                try:
                    out.append(run[:n].decode("utf-8"))
                except UnicodeDecodeError:
                    n = 1
                    out.append("�")
                run = run[n:]
            if i >= 0:
                s = self.surface[i].decode("utf-8")
                out.append(s[1:] if k == first and self.prefixed[i] else s)
        return "".join(out)


_codecs: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """The codec of a model, made once in each worker; kept until a task of another operator begins."""
    if model_path not in _codecs:
        _codecs[model_path] = PieceCodec(model_path)
        keep_between_tasks(__name__, _codecs.clear)
    return _codecs[model_path]


# ------------------------------------------------------------------ DataFrames


def _encoded(batches: Iterable[pa.RecordBatch], path: str, column: str, to: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in pieces(batches, column):
        ids = own.encode([as_text(x) for x in batch.column(column).to_pylist()])
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32()))
        rest = [(n, batch.column(n)) for n in batch.schema.names if n != column]
        yield pa.RecordBatch.from_arrays([c for _, c in rest] + [values], names=[n for n, _ in rest] + [to])


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` without ``text`` and with its ids (array<int>) as the last column."""
    if ids in df.columns and ids != text:
        raise ValueError(f"column {ids} exists; name another one")
    raw = "__text"
    while raw in df.columns:
        raw = "_" + raw
    rest = [c for c in df.columns if c != text]
    schema = with_field(df.select(*(f"`{c}`" for c in rest)).schema, ids, "array<int>")
    return per_task(df.select(*(f"`{c}`" for c in rest), text_bytes(f"`{text}`").alias(raw)), _encoded, schema, model_path, raw, ids)


def _decoded(batches: Iterable[pa.RecordBatch], path: str, column: str, to: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        texts = [own.decode(x or []) for x in batch.column(column).to_pylist()]
        rest = [(n, batch.column(n)) for n in batch.schema.names if n != column]
        yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(texts, pa.string())], names=[n for n, _ in rest] + [to])


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` without ``ids`` and with their text as the last column; null ids decode to ''."""
    if text in df.columns and ids != text:
        raise ValueError(f"column {text} exists; name another one")
    rest = [c for c in df.columns if c != ids]
    schema = with_field(df.select(*(f"`{c}`" for c in rest)).schema, text, "string")
    return per_task(df, _decoded, schema, model_path, ids, text)


def _there_and_back(batches: Iterable[pa.RecordBatch], path: str, column: str, ids_to: str, text_to: str) -> Iterator[pa.RecordBatch]:
    for batch in _encoded(batches, path, column, ids_to):
        texts = [codec(path).decode(x.values.to_numpy()) for x in batch.column(ids_to)]
        yield batch.append_column(text_to, pa.array(texts, pa.string()))


def there_and_back(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text`` and, in its place, the text that they decode to; both last.

    One pass: a task keeps one worker with one set of remembered words.
    """
    if ids in df.columns:
        raise ValueError(f"column {ids} exists; name another one")
    raw = "__text"
    while raw in df.columns:
        raw = "_" + raw
    rest = df.select(*(f"`{c}`" for c in df.columns if c != text))
    schema = with_field(with_field(rest.schema, ids, "array<int>"), text, "string")
    return per_task(df.select(*(f"`{c}`" for c in rest.columns), text_bytes(f"`{text}`").alias(raw)), _there_and_back, schema, model_path, raw, ids, text)


def _lengths(batches: Iterable[pa.RecordBatch], path: str, column: str, to: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in pieces(batches, column):
        n = [len(x) for x in own.encode([as_text(x) for x in batch.column(column).to_pylist()])]
        rest = [(c, batch.column(c)) for c in batch.schema.names if c != column]
        yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(n, pa.int64())], names=[c for c, _ in rest] + [to])


def lengths(df: DataFrame, model_path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """The other columns of ``df`` and the number of ids of ``text``."""
    rest = [c for c in df.columns if c != text]
    if name in rest:
        raise ValueError(f"column {name} exists; name another one")
    raw = "__text"
    while raw in rest:
        raw = "_" + raw
    schema = with_field(df.select(*(f"`{c}`" for c in rest)).schema, name, "long")
    return per_task(df.select(*(f"`{c}`" for c in rest), text_bytes(f"`{text}`").alias(raw)), _lengths, schema, model_path, raw, name)


def _digests(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    digits = [str(i) for i in range(len(own.pieces))]
    for batch in pieces(batches):
        n, ids_sha, text_sha = [], [], []
        for ids in own.encode([as_text(x) for x in batch.column("text").to_pylist()]):
            ids = ids.tolist()
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(own.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document: encoded, then decoded."""
    return per_task(df.select("doc_id", text_bytes().alias("text")), _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", model_path)
