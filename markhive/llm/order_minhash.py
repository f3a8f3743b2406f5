"""Document fingerprints by Order MinHash.

A text's k-mers (K characters) are numbered by occurrence, so that a k-mer
found twice counts as two.  For each of SKETCHES hash functions the TUPLE
smallest numbered k-mers are taken, put back in the order of the text, and
hashed together.  Two texts share an entry only where they share these k-mers
in the same order: the share of equal entries falls with the edit distance.

``with_edited`` compares every document with an edited copy whose end is the
beginning of the next document by descending doc_id.  Documents are dealt by
ranges of doc_id and sorted within the range; the first document of a range is
sent along to the range before it.  Each text is shuffled once.

Cases: null and empty texts share one fixed fingerprint, as do all equal texts;
a text of less than K characters is one k-mer.  A single document is its own
next one.  Null doc_ids come last; equal doc_ids are ordered by text.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markhive.llm.common import as_text, partitions_of, per_task, pieces, text_bytes, with_field

#: Characters of a k-mer, k-mers of a tuple, and tuples of a fingerprint.
K, TUPLE, SKETCHES = 12, 2, 32
#: k-mers at a time.
BLOCK = 4096
MOST = np.iinfo(np.uint64).max
STEP = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _kmers(text: str, k: int) -> np.ndarray:
    """Hashes of the text's occurrence-numbered k-mers, in text order."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * STEP
    width, out, covered = 1, None, 0
    with np.errstate(over="ignore"):
        h = _spread(h)
        k = min(k, len(h))
        while k:  # binary powers of the window: h holds hashes of ``width`` characters
            if k & 1:
                n = len(h) if out is None else min(len(out), len(h) - covered)
                out = h if out is None else _spread(out[:n] * STEP + h[covered : covered + n])
                covered += width
            k >>= 1
            if k:
                h = _spread(h[:-width] * np.uint64(0xC2B2AE3D27D4EB4F) + h[width:])
                width *= 2
        ordered = np.sort(out)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(again):
            out = out.copy()
            at = np.flatnonzero(np.isin(out, again))
            at = at[np.argsort(out[at], kind="stable")]
            first = np.r_[True, out[at][1:] != out[at][:-1]]
            number = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            out[at] = np.where(number > 0, _spread(out[at] + number.astype(np.uint64) * STEP), out[at])
    return out


def _multipliers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _spread(np.arange(1, n + 1, dtype=np.uint64) * STEP) | np.uint64(1)


def sketch(text: str, k: int = K, size: int = TUPLE, sketches: int = SKETCHES) -> np.ndarray:
    """The fingerprint's entries (uint32)."""
    if not text:
        return np.zeros(sketches, np.uint32)
    h = _kmers(text, k)
    size = min(size, len(h))
    rows = np.arange(sketches)[:, None]
    m = _multipliers(sketches)[:, None]
    low, at = [], []
    with np.errstate(over="ignore"):
        for b in range(0, len(h), BLOCK):  # k-mers at a time, to stay in the processor's cache
            x = h[b : b + BLOCK] * m
            for _ in range(min(size, x.shape[1])):
                i = x.argmin(axis=1)[:, None]
                low.append(x[rows, i])
                at.append(b + i)
                x[rows, i] = MOST
        low, at = np.hstack(low), np.hstack(at)
        chosen = np.sort(at[rows, np.argsort(low, axis=1)[:, :size]], axis=1)  # back in text order
        value = np.arange(sketches, dtype=np.uint64)
        for k in range(size):
            value = _spread(value * STEP + h[chosen[:, k]])
    return (value >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _printed(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def _fingerprinted(batches: Iterable[pa.RecordBatch], column: str, name: str) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, column):
        prints = [_printed(sketch(as_text(x))) for x in batch.column(column).to_pylist()]
        rest = [(n, batch.column(n)) for n in batch.schema.names if n != column]
        yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(prints, pa.string())], names=[n for n, _ in rest] + [name])


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of ``text``: 8 hexadecimal digits for each entry."""
    if name in df.columns:
        raise ValueError(f"column {name} exists; name another one")
    raw = "__text"
    while raw in df.columns:
        raw = "_" + raw
    return per_task(df.withColumn(raw, text_bytes(f"`{text}`")), _fingerprinted, with_field(df.schema, name, "string"), raw, name)


# ------------------------------------------------------------------ documents and the next one


def _ranged(batches: Iterable[pa.RecordBatch], bounds: list[int], place: dict[int, int], ends: dict[int | None, int]) -> Iterator[pa.RecordBatch]:
    """Adds each document's range; the first document of a range also goes to the range before, after its documents."""
    names = ["doc_id", "text", "range", "after"]
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        ranges = [place[_range(d, bounds)] for d in ids]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranges, pa.int64()), pa.array(np.zeros(len(ids), np.int32))], names=names)
        again = [i for i, d in enumerate(ids) if d in ends]
        if again:
            some = batch.take(pa.array(again))
            to = pa.array([ends[ids[i]] for i in again], pa.int64())
            yield pa.RecordBatch.from_arrays([*some.columns, to, pa.array(np.ones(len(again), np.int32))], names=names)


def _range(doc: int | None, bounds: list[int]) -> int:
    """Ranges in descending order of doc_id: 0 above the last bound; null last."""
    return len(bounds) + 1 if doc is None else len(bounds) - bisect.bisect_left(bounds, doc)


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # (range, doc_id, text, sketch): waits for its next document
    rows: list[tuple] = []
    for batch in pieces(batches):
        for doc, raw, r, after in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "after")), strict=True):
            text = None
            if held is not None:
                text = as_text(raw)
                own = sketch(text)
                _, held_doc, held_text, held_sketch = held
                cut = len(held_text) // 3
                edited = held_text[: len(held_text) - cut] + text[:cut]
                other = sketch(edited)
                rows.append((held_doc, len(held_text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), _printed(held_sketch), _printed(other), likeness(held_sketch, other), likeness(held_sketch, own)))
                held = None if after else (r, doc, text, own)
            elif not after:
                text = as_text(raw)
                held = (r, doc, text, sketch(text))
        if rows:
            yield _rows(rows)
            rows = []
    if held is not None:
        raise ValueError("a range without its end")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def with_edited(df: DataFrame) -> DataFrame:
    """Fingerprints of each document and its edited copy, and their likeness (see FIELDS)."""
    spark = df.sparkSession
    docs = df.select("doc_id", text_bytes().alias("text"))
    n = partitions_of(spark)
    # ranges of about equal counts, from the ids alone; their bounds and highest ids reach the driver
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n + 1000)).first()[0] or []
    bounds = sorted(set(cuts))
    above = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda b: b < F.col("doc_id")))
    in_range = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(len(bounds) - above)
    tops = sorted(docs.groupBy(in_range.alias("range")).agg(F.max("doc_id")).collect())
    if not tops:
        return spark.createDataFrame([], FIELDS)
    place = {r: i for i, (r, _) in enumerate(tops)}  # ranges that have rows
    ends = {top: (i or len(tops)) - 1 for i, (_, top) in enumerate(tops)}
    sent = per_task(docs, _ranged, "doc_id long, text binary, range long, after int", bounds, place, ends)
    sent = sent.repartition(n, "range").sortWithinPartitions("range", "after", F.col("doc_id").desc_nulls_last(), "text")
    return per_task(sent, _compared, FIELDS)
