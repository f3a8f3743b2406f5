"""Integer vectors of embedding tables: validity, floors and a compact binary form.

A vector's entries c become ``floor(scale * c)``.  Rows whose vector is null or
holds a null or non-finite entry are left out.  Vectors of different lengths in
one table count as padded with zeros up to the longest; entries beyond +-2^62
after scaling are held there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markhive.llm.common import per_task

#: Scaled entries are held inside this range.
LARGEST = 1 << 62
#: Rows of a batch that are worked on at once.
ROWS = 4096


@dataclass(frozen=True)
class Form:
    """How the integer vectors of a table are written: entries a vector, their type, and their range."""

    dim: int
    code: str  # numpy type, little endian
    low: int
    high: int

    @property
    def largest(self) -> int:
        return max(abs(self.low), abs(self.high))


def free_name(name: str, taken: Iterable[str]) -> str:
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = "_" + name
    return name


def _floors(column: pa.ListArray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are whole, the entries of those (one after the other) as floors, and their lengths."""
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    odd = np.bincount(owner[~np.isfinite(values)], minlength=len(lengths)) > 0
    whole = column.is_valid().to_numpy(zero_copy_only=False) & ~odd
    with np.errstate(over="ignore"):
        x = np.floor(scale * values[whole[owner]])
    return whole, np.clip(x, -float(LARGEST), float(LARGEST)).astype(np.int64), lengths[whole]


def _small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _measured(batches: Iterable[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    dim, low, high = 0, 0, 0
    for batch in _small(batches):
        _, x, lengths = _floors(batch.column(0), scale)
        if len(x):
            dim, low, high = max(dim, int(lengths.max())), min(low, int(x.min())), max(high, int(x.max()))
    yield pa.RecordBatch.from_pydict({"dim": [dim], "low": [low], "high": [high]})


def form_of(df: DataFrame, vector: str, scale: float) -> Form:
    """The form that fits all vectors of ``df``; one row of three numbers reaches the driver."""
    got = per_task(df.select(F.col(f"`{vector}`").cast("array<double>").alias("v")), _measured, "dim long, low long, high long", scale)
    dim, low, high = got.agg(F.max("dim"), F.min("low"), F.max("high")).first()
    dim, low, high = dim or 0, low or 0, high or 0
    code = next(c for c in ("i1", "i2", "i4", "i8") if np.iinfo(c).min <= low and high <= np.iinfo(c).max)
    return Form(dim, "<" + code, low, high)


def _packed(batches: Iterable[pa.RecordBatch], scale: float, form: Form, column: str) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        whole, x, lengths = _floors(batch.column(column), scale)
        out = np.zeros((len(lengths), form.dim), form.code)
        row = np.repeat(np.arange(len(lengths)), lengths)
        out[row, np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = x
        rest = batch.filter(pa.array(whole))
        columns = [binary(out) if n == column else rest.column(n) for n in batch.schema.names]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def packed(df: DataFrame, vector: str, scale: float, form: Form) -> DataFrame:
    """``df`` with ``vector`` in binary form; rows without a whole vector are left out."""
    schema = ", ".join(f"`{c}` {'binary' if c == vector else kind}" for c, kind in df.dtypes)
    return per_task(df.withColumn(vector, F.col(f"`{vector}`").cast("array<double>")), _packed, schema, scale, form, vector)


def binary(rows: np.ndarray) -> pa.Array:
    """Equally long rows of numbers as an Arrow array of bytes."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def numbers(column: pa.Array, form: Form) -> np.ndarray:
    """Rows of numbers from an Arrow array of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), form.code).reshape(len(column), form.dim)
