"""Images made from ``part`` by integer formulas, the same in every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same relations for DuckDB.
IMAGES_SQL = "SELECT p_partkey AS image_id, CAST(4 + p_partkey % 13 AS INTEGER) AS w, CAST(3 + p_size % 11 AS INTEGER) AS h FROM part"
PIXELS_SQL = f"""
SELECT image_id, w, h, y, x,
  CAST((image_id * 31 + x * 7 + y * 13) % 256 AS INTEGER) AS r, CAST((image_id * 17 + x * 3 + y * 29) % 256 AS INTEGER) AS g,
  CAST((image_id * 5 + x * x + y) % 256 AS INTEGER) AS b, CAST((image_id + x * 41 + y * 11) % 256 AS INTEGER) AS a
FROM (SELECT *, CAST(unnest(range(w)) AS INTEGER) AS x FROM (SELECT *, CAST(unnest(range(h)) AS INTEGER) AS y FROM ({IMAGES_SQL})))
"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("image_id"), (4 + F.col("p_partkey") % 13).cast("int").alias("w"), (3 + F.col("p_size") % 11).cast("int").alias("h"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = images(spark, sf_dir).withColumn("y", F.explode(F.expr("sequence(0, h - 1)"))).withColumn("x", F.explode(F.expr("sequence(0, w - 1)")))
    colours = {"r": "image_id * 31 + x * 7 + y * 13", "g": "image_id * 17 + x * 3 + y * 29", "b": "image_id * 5 + x * x + y", "a": "image_id + x * 41 + y * 11"}
    return grid.select("image_id", "w", "h", "y", "x", *[F.expr(f"CAST(({e}) % 256 AS int)").alias(c) for c, e in colours.items()])
