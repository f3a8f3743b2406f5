"""Quality scores from a byte-level convolutional network, in numpy.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes that overlap by OVERLAP
and cover all of it; the last chunk ends with the text, a text shorter than a
chunk is filled up.  Every byte becomes a short learned vector.  FILTERS learned
filters over WIDTH bytes slide over each chunk by one byte, and each filter's
largest response in the chunk stays.  A layer of HIDDEN units turns these into
the chunk's features; their maxima and means over the text's chunks give one
logit, and so one probability for the whole text.

The network learns with Adam from at most SAMPLE_ROWS labelled rows (the
documented bound), chosen by a hash of their ids; a training text shows at most
SAMPLE_CHUNKS of its chunks, evenly spaced over it.  That bounds what reaches the
driver.  The gradient of a filter comes only from the place of its maximum.
Scores always use every chunk.

Cases: null and empty texts are one chunk of filling and have that chunk's score.
Without training labels of both kinds every score is the share of good labels
(0.5 without any).  A document with several labels is good if all say so; of
rows that repeat an id one text is learned from, and each row is scored.  Texts
of any length are scored a few chunks at a time.  Labels, language, source and
ids are no inputs of a score; other columns stay as they are in ``score``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markhive.llm.common import per_task, pieces, text_bytes, with_field
from markhive.llm.vectors import free_name

#: Bytes of a chunk, bytes that two chunks share, and the byte that fills a short text.
CHUNK, OVERLAP, FILL = 512, 64, 256
#: Numbers a byte becomes, bytes a filter covers, filters, and units of the layer over them.
EMBED, WIDTH, FILTERS, HIDDEN = 8, 6, 48, 32
#: Labelled rows to learn from, and chunks that one of them shows at most.
SAMPLE_ROWS, SAMPLE_CHUNKS = 4_000, 64
#: Steps of Adam, texts a step, and learning rate.
STEPS, BATCH, RATE = 700, 32, 3e-3
#: Chunks that are convolved at once.
SLICE = 32
#: Score from which a text is predicted to be good.
GOOD = 0.3


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array of numbers, the place of every chunk, and the text that it belongs to."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    room = np.maximum(lengths, CHUNK)
    first = np.cumsum(room) - room
    numbers = np.full(int(room.sum()), FILL, np.int16)
    for start, text in zip(first.tolist(), texts, strict=True):
        numbers[start : start + len(text)] = np.frombuffer(text, np.uint8)
    step = CHUNK - OVERLAP
    count = 1 + -(-(room - CHUNK) // step)
    owner = np.repeat(np.arange(len(texts)), count)
    place = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * step
    return numbers, first[owner] + np.minimum(place, (room - CHUNK)[owner]), owner


@dataclass
class Network:
    """The parameters: bytes, filters with their offsets, layer, and the last weights; or only a share of good texts."""

    embed: np.ndarray  # 257 x EMBED; filling is zero
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    offset: np.ndarray
    layer: np.ndarray  # FILTERS x HIDDEN
    layer_offset: np.ndarray
    out: np.ndarray  # for maxima, then for means
    base: np.ndarray
    share: float | None = None

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        def spread(*shape: int, by: float) -> np.ndarray:
            return (rng.normal(size=shape) * by).astype(np.float32)

        own = cls(
            spread(257, EMBED, by=0.5),
            spread(WIDTH * EMBED, FILTERS, by=(WIDTH * EMBED) ** -0.5),
            np.zeros(FILTERS, np.float32),
            spread(FILTERS, HIDDEN, by=FILTERS**-0.5),
            np.zeros(HIDDEN, np.float32),
            spread(2 * HIDDEN, by=(2 * HIDDEN) ** -0.5),
            np.zeros(1, np.float32),
        )
        own.embed[FILL] = 0
        return own

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.offset, self.layer, self.layer_offset, self.out, self.base]

    def strongest(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter in every chunk (rows of numbers), and its place."""
        best, place = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int64)
        for a in range(0, len(chunks), SLICE):
            x = self.embed[chunks[a : a + SLICE]]
            shape = (len(x), CHUNK - WIDTH + 1, WIDTH * EMBED)
            windows = np.lib.stride_tricks.as_strided(x, shape, (x.strides[0], x.strides[1], x.itemsize))
            # a product for each chunk: in one for all, rounding may depend on the chunks beside it
            y = np.ascontiguousarray(windows) @ self.filters
            at = y.argmax(axis=1)
            place[a : a + SLICE] = at
            best[a : a + SLICE] = np.take_along_axis(y, at[:, None], axis=1)[:, 0]
        return best, place

    def over_chunks(self, response: np.ndarray) -> np.ndarray:
        """Features of chunks from their filters' largest responses."""
        lit = np.maximum(response + self.offset, 0)
        # a product for each chunk here too
        return np.maximum((lit[:, None] @ self.layer)[:, 0] + self.layer_offset, 0)

    def probability(self, texts: list[bytes]) -> np.ndarray:
        """Of every whole text, to be good."""
        if self.share is not None:
            return np.full(len(texts), self.share)
        if not texts:
            return np.zeros(0)
        numbers, place, owner = cut(texts)
        features = np.empty((len(place), HIDDEN), np.float32)
        for a in range(0, len(place), SLICE):
            best, _ = self.strongest(numbers[place[a : a + SLICE, None] + np.arange(CHUNK)])
            features[a : a + SLICE] = self.over_chunks(best)
        starts = np.searchsorted(owner, np.arange(len(texts)))
        means = np.add.reduceat(features, starts) / np.bincount(owner)[:, None]
        z = (np.concatenate([np.maximum.reduceat(features, starts), means], axis=1) * self.out).sum(axis=1) + self.base
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))

    def gradients(self, chunks: np.ndarray, owner: np.ndarray, good: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy, for texts given as chunks and their owners (0, 1, ... in order)."""
        response, place = self.strongest(chunks)
        response += self.offset
        lit = np.maximum(response, 0)
        features = np.maximum(lit @ self.layer + self.layer_offset, 0)
        starts, count = np.searchsorted(owner, np.arange(len(good))), np.bincount(owner)[:, None]
        top = np.maximum.reduceat(features, starts)
        pooled = np.concatenate([top, np.add.reduceat(features, starts) / count], axis=1)
        p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.base, -30, 30)))
        dz = ((p - good) / len(good)).astype(np.float32)
        # back to features: the mean's share, and the maximum's where it was reached
        reached = (features == top[owner]).astype(np.float32)
        reached /= np.add.reduceat(reached, starts)[owner]
        d_features = ((dz[:, None] * self.out[HIDDEN:] / count)[owner] + (dz[:, None] * self.out[:HIDDEN])[owner] * reached) * (features > 0)
        d_response = (d_features @ self.layer.T) * (response > 0)
        # back to bytes: only the window of each maximum
        window = chunks[np.arange(len(chunks))[:, None, None], place[:, :, None] + np.arange(WIDTH)].astype(np.int64)
        seen = self.embed[window].reshape(len(chunks), FILTERS, WIDTH * EMBED)
        d_filters = np.einsum("cfk,cf->kf", seen, d_response, optimize=True)
        d_bytes = (d_response[:, :, None] * self.filters.T[None]).reshape(-1, EMBED)
        d_embed = np.stack([np.bincount(window.ravel(), weights=d, minlength=257) for d in d_bytes.T], axis=1).astype(np.float32)
        d_embed[FILL] = 0
        return [d_embed, d_filters, d_response.sum(axis=0), lit.T @ d_features, d_features.sum(axis=0), pooled.T @ dz, dz.sum(keepdims=True)]


def trained(texts: list[np.ndarray], good: np.ndarray, seed: int = 1, steps: int = STEPS) -> Network:
    """A network fitted on texts given as rows of chunks."""
    rng = np.random.default_rng(seed)
    own = Network.fresh(rng)
    means, squares = ([np.zeros_like(x) for x in own.parameters] for _ in range(2))
    order = np.empty(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < BATCH:
            order = np.r_[order, rng.permutation(len(texts))]
        some, order = order[:BATCH], order[BATCH:]
        owner = np.repeat(np.arange(len(some)), [len(texts[k]) for k in some])
        rate = RATE * min(1.0, step / 20) * (1 - 0.95 * step / steps)
        for x, m, s, g in zip(own.parameters, means, squares, own.gradients(np.concatenate([texts[k] for k in some]), owner, good[some]), strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            x -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return own


# ------------------------------------------------------------------ DataFrames


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _shown(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks to learn from, as 16-bit numbers."""
    for batch in pieces(batches):
        numbers, place, owner = cut(batch.column("text").to_pylist())
        shown = []
        for k in range(batch.num_rows):
            own = place[owner == k]
            own = own[np.unique(np.linspace(0, len(own) - 1, min(len(own), SAMPLE_CHUNKS)).round().astype(np.int64))]
            shown.append(numbers[own[:, None] + np.arange(CHUNK)].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.array(shown, pa.binary())], names=["doc_id", "good", "chunks"])


def learn(df: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network:
    """The network for ``df`` (doc_id, text), from ``labels`` (doc_id, quality) that are not held out."""
    known = labels.where("doc_id is not null and quality is not null").where(~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("good"))
    # at most sample_rows ids: small enough to be sent to every task
    sample = known.orderBy(F.xxhash64(F.lit(12), "doc_id"), "doc_id").limit(sample_rows)
    texts = df.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("text").alias("text")).select("doc_id", "good", text_bytes().alias("text"))
    rows = per_task(texts, _shown, "doc_id long, good int, chunks binary").toArrow().sort_by("doc_id")
    good = rows.column("good").to_numpy()
    if len(set(good.tolist())) < 2:
        empty = np.zeros(0, np.float32)
        return Network(*[empty] * 7, share=float(good.mean()) if len(good) else 0.5)
    return trained([np.frombuffer(c, np.int16).reshape(-1, CHUNK) for c in rows.column("chunks").to_pylist()], good.astype(np.float32))


def _scored(batches: Iterable[pa.RecordBatch], network, column: str, name: str) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, column):
        scores = network.value.probability(batch.column(column).to_pylist())
        rest = [(n, batch.column(n)) for n in batch.schema.names if n != column]
        yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(scores, pa.float64())], names=[n for n, _ in rest] + [name])


def score(df: DataFrame, network: Network, text: str = "text", name: str = "quality_score") -> DataFrame:
    """``df`` with the score (0 to 1) of ``text`` as the last column."""
    if name.lower() in map(str.lower, df.columns):
        raise ValueError(f"column {name} exists; name another one")
    raw = free_name("__text", df.columns)
    told = df.sparkSession.sparkContext.broadcast(network)
    return per_task(df.withColumn(raw, text_bytes(f"`{text}`")), _scored, with_field(df.schema, name, "double"), told, raw, name)


def judged(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    scored = score(df.select("doc_id", "text"), learn(df, labels), name="score")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
