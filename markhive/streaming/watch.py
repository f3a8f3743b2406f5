"""Dedup of bookmark files as they arrive in a folder (Structured Streaming).

The batch dedup is per file, so it needs no state across files: each
micro-batch holds whole files (``wholetext``), is parsed and deduplicated like
a batch job in ``foreachBatch``, and its result becomes the batch's own
partition of a parquet table.  The stream's checkpoint records which files were
done; a batch that is run again overwrites its partition, so a restarted job
neither loses nor repeats a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import decode_percent
from ..operators import dedup
from ..operators.extract import parse_bookmarks
from ..options import KeyOptions


def watch_dedup(
    spark: SparkSession,
    input_dir: str,
    output: str,
    opts: KeyOptions = KeyOptions(),
    batch_mode: str = "all",
    *,
    checkpoint: str,
    glob: str = "*.html",
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
):
    """Start the stream; returns the ``StreamingQuery``.

    ``checkpoint`` is the stream's own folder, the same for every run.
    ``available_now`` processes what is there and stops (scheduled runs);
    otherwise the query keeps watching.
    """
    reader = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    files = reader.load(input_dir).select(
        decode_percent(F.col("_metadata.file_path")).alias("file_id"), F.col("value").alias("html")
    )

    def run_batch(batch: DataFrame, epoch_id: int) -> None:
        links = parse_bookmarks(batch).links
        kept = dedup.batch_dedup(links, opts, batch_mode=batch_mode)
        # a batch that runs again replaces its own partition
        out = kept.withColumn("batch_id", F.lit(epoch_id)).write.mode("overwrite")
        out.option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "mode").parquet(output)

    writer = files.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
