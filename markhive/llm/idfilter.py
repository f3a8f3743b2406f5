"""A Bloom filter of ids, of fixed size, to keep rows that no join will need out of a shuffle.

It never decides alone: a row that it lets through is joined exactly afterwards.
With more ids than it is made for it lets more rows through, up to all of them;
results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markhive.llm.common import per_task

#: Bits of a filter (4 MB) and hash functions.
BITS, HASHES = 1 << 25, 4


def _places(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        step = x >> np.uint64(32) | np.uint64(1)
        return np.stack([(x + np.uint64(k) * step) % np.uint64(BITS) for k in range(HASHES)])


def _marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
        at = _places(ids).ravel()
        word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
        mask = np.zeros(len(word), np.uint64)
        np.bitwise_or.at(mask, inverse, np.uint64(1) << (at & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])


def id_filter(ids: DataFrame):
    """The filter of the (first) long column of ``ids``, as a broadcast variable."""
    found = per_task(ids, _marked, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return ids.sparkSession.sparkContext.broadcast(bits)


def _let_through(batches: Iterable[pa.RecordBatch], column: str, bits, inside: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(column)
        at = _places(ids.fill_null(0).to_numpy(zero_copy_only=False))
        maybe = (bits.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=0)
        maybe &= ids.is_valid().to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(maybe == inside))


def maybe_in(df: DataFrame, column: str, bits) -> DataFrame:
    """Rows whose id may be in the filter: all that are, and a few others."""
    return per_task(df, _let_through, df.schema, column, bits, True)


def surely_not_in(df: DataFrame, column: str, bits) -> DataFrame:
    """The other rows, among them those with a null id."""
    return per_task(df, _let_through, df.schema, column, bits, False)
