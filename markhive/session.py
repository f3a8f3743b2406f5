"""Session helpers for tests, the bench and local runs.

Library functions never build a session; they take the caller's DataFrames.
On a cluster the caller's session config wins: nothing here overrides a
setting that is already present, except in ``local_session``.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # many small bookmark exports: pack them, 4 MB per file open
    "spark.sql.files.openCostInBytes": str(4 << 20),
    # drop checkpoint files once their DataFrames are gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, app: str = "markhive", event_log: str | None = None
) -> SparkSession:
    """Local session; ``event_log`` writes Spark's event log to that folder."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    if event_log:
        builder = (
            builder.config("spark.eventLog.enabled", "true")
            .config("spark.eventLog.dir", event_log)
            .config("spark.eventLog.compress", "false")
        )
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("MARKHIVE_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Read from ``spark.checkpoint.dir`` (or an earlier ``setCheckpointDir``).
    Where neither is set, a session that runs in one process gets a fresh
    scratch folder; on a cluster that is an error, since executors would not
    see each other's files.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="markhive-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path
