"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from markhive.packaging import ship
from markhive.session import ensure_checkpoint_dir

#: Arrow batches are cut into pieces of about this many text bytes, so that a
#: task's Python memory follows this number and the longest text, not the rows.
PIECE_BYTES = 1 << 20
#: Bytes of a batch that Spark hands to a Python worker; the records of a batch alone don't bound its memory.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(col: str | Column = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("binary"), F.lit(b""))


def as_text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, cut so that ``column`` holds about PIECE_BYTES at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > PIECE_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, lineage cut.

    The files outlive the executors that wrote them; they may be removed with
    the checkpoint folder once the results that read them are written.
    rows: of a row group at most; for wide rows, since writers and readers hold a
    row group or thousands of its rows at a time.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if rows:
        writer = writer.option("parquet.block.row.count.limit", str(rows))
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the files of shuffles that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def with_field(schema: StructType, name: str, kind: str) -> StructType:
    """The schema and one more field."""
    return StructType([*schema.fields, StructField(name, _parse_datatype_string(kind))])


def partitions_of(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def per_task(df: DataFrame, make: Callable, schema: str, *args) -> DataFrame:
    """``mapInArrow`` of a module-level generator with bound arguments."""

    ship(df.sparkSession)

    def run(batches):
        let_go(make.__module__)
        yield from make(batches, *args)
        give_back()

    return df.mapInArrow(run, schema)


#: What a worker keeps from task to task: module of the operator, and what forgets it.
_kept: dict[str, Callable[[], None]] = {}


def keep_between_tasks(module: str, forget: Callable[[], None]) -> None:
    """A worker may serve many tasks of an operator; what it remembers goes when a task of another one begins."""
    _kept[module] = forget


def let_go(module: str) -> None:
    for other in [m for m in _kept if m != module]:
        _kept.pop(other)()


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python workers hold about BATCH_BYTES from now on, unless the session sets a bound itself."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Returns freed memory to the system: Spark keeps a worker for later tasks, and others run beside it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a C library that has it
        pass
