"""Queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import codec_queries, meta_queries, pixel_queries

QUERIES: dict = {**pixel_queries.QUERIES, **codec_queries.QUERIES, **meta_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**pixel_queries.ORACLE_SQL, **codec_queries.ORACLE_SQL, **meta_queries.ORACLE_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["px_crop_rot90"](spark, sf_dir)
