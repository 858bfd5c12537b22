"""What a session needs before Python functions of this package run on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: How Python workers hold memory: freed arrays go back to the system, so idle workers stay small.
WORKER_ENVIRONMENT = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_MMAP_THRESHOLD_": "1048576"}
#: Arrow batches are also bounded in bytes: ten thousand rows of long texts wouldn't be small.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's modules to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="pixelloom-"), "pixelloom.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.join("pixelloom", os.path.relpath(full, root)))
        context.addPyFile(path)
        for name, value in WORKER_ENVIRONMENT.items():
            context.environment.setdefault(name, value)
        if not context.getConf().contains(BATCH_BYTES[0]):
            spark.conf.set(*BATCH_BYTES)
        _shipped.add(context.applicationId)
    return spark
