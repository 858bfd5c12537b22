"""A pipeline over ``documents``: filter, deduplicate twice, mix, tokenize.

Every stage reads doc_id, text and source and passes all other columns on, whatever their
names, and gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import byte_bpe
from pixelloom.llm.mixing import poisson_mix
from pixelloom.llm.ngram_jaccard import keep_first
from pixelloom.llm.quality_rules import keep_quality
from pixelloom.llm.registry import ranks
from pixelloom.llm.storage import stored
from pixelloom.llm.substring_dedup import drop_passages, repeated_passages
from pixelloom.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them."""
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Documents without an id can't be grouped and stay; equal rows stay once.
    """
    ship(spark)
    return keep_first(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; ``n_chars`` follows the text. A text left bare goes; null ids and texts stay as they are."""
    ship(spark)
    cleaned = drop_passages(docs, repeated_passages(docs))
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to their sources' target weights and shuffled; a null source is one of its own."""
    return poisson_mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and of the decoded bytes."""
    ship(spark)
    coded = byte_bpe.bpe_decode(byte_bpe.bpe_encode(docs, *ranks()), *ranks())
    return coded.select("doc_id", "lang", "source", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", passages), ("mixing sources", mix), ("byte-level BPE", tokens)]

#: No stage after the first can be stated in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
