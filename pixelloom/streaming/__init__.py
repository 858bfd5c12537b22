"""Metadata of new files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.meta import columns
from ..sources import stream_files


def stream_audits(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, modificationTime, length, <flags>)`` of every file that arrives; stateless."""
    files = stream_files(spark, path, glob)
    return files.select("path", "modificationTime", "length", columns.audit(columns.read(F.col("content"))).alias("a")).select("path", "modificationTime", "length", "a.*")
