"""Makes the package importable in Python workers, wherever the driver started.

``ship`` zips the package's sources and hands them to Spark, which serves them
to every executor (also to those that start later).  It does nothing the second
time for a session, or where there is no session of the classic kind.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    if not os.path.isdir(_PACKAGE):  # already imported from a shipped zip
        _shipped.add(sc.applicationId)
        return
    name = os.path.basename(_PACKAGE)
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}-sources.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(_PACKAGE):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, _PACKAGE)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
