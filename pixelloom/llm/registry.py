"""The registered query of each operator, with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe
from .chat_tree import chat_digests
from .cover_tree import quantized, top_k_inner_product
from .kneser_ney import held_out_scores
from .language_id import held_out_languages
from .mixing import poisson_mix
from .ngram_jaccard import jaccard_groups
from .quality_rules import quality_report
from .substring_dedup import repeated_passages
from .warc import warc_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks() -> tuple[str, str]:
    """(rank file, split pattern) of the registered queries; both are parameters of the operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(_table(spark, sf_dir, "embeddings"))
    return top_k_inner_product(vectors.where("vec_id % 20 = 0"), vectors, k=20)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_digests(_table(spark, sf_dir, "documents"), *ranks())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix(_table(spark, sf_dir, "documents"))


def op6_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_digests(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_languages(_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_table(spark, sf_dir, "documents"), n=5, percent=80).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_scores(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_cover_tree": op1_cover_tree,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_warc": op4_warc,
    "op5_mix_sources": op5_mix_sources,
    "op6_chat_tree": op6_chat_tree,
    "op7_language_id": op7_language_id,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_quality_rules": op9_quality_rules,
    "op10_kneser_ney": op10_kneser_ney,
}
OP5_SQL = """
WITH sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars FROM documents GROUP BY source
), weighed AS (
  SELECT source, chars, CAST(floor(sqrt(CAST(chars AS DOUBLE)) * 1000) AS BIGINT) AS weight FROM sizes
), rates AS (
  SELECT source, CASE WHEN chars > 0 THEN coalesce(CAST((SELECT sum(chars) FROM weighed) AS DOUBLE) * (CAST(weight AS DOUBLE) / CAST((SELECT sum(weight) FROM weighed) AS DOUBLE)) / chars, 0.0) ELSE 0.0 END AS rate FROM weighed
), tables AS (
  SELECT source, CASE WHEN rate > 0 THEN list_transform(range(0, CAST(ceil(rate + 10 * sqrt(rate) + 20) AS BIGINT) + 1), lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(i * ln(rate) - rate - lgamma(i + 1))))) ELSE [1.0] END AS cdf FROM rates
), drawn AS (
  SELECT d.*, CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents d
), counted AS (
  SELECT d.*, CAST(len(list_filter(t.cdf, lambda p: p <= d.u)) AS INTEGER) AS mix_copies FROM drawn d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
), copied AS (
  SELECT * EXCLUDE (u), CAST(unnest(range(1, mix_copies + 1)) AS INTEGER) AS mix_copy FROM counted
)
SELECT *, md5('mix/order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(mix_copy AS VARCHAR)) AS mix_order FROM copied
"""

OP1_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""

OP4_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages WHERE page_id IS NOT NULL
), m AS (
  SELECT payload_digest, max(page_id) AS stored_as FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN stored_as <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN stored_as <> page_id THEN stored_as END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""

OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows WHERE conv_id IS NOT NULL
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(19 + 2 * length(role || text) - length(translate(role || text, '\<[/', ''))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP8_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM split
), sizes AS (
  SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM sets
), grams AS (
  SELECT doc_id, unnest(g) AS gram FROM sets
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y USING (gram) WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), reached(doc_id, root) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT links.b, reached.root FROM reached JOIN links ON links.a = reached.doc_id
), roots AS (
  SELECT doc_id, min(root) AS component_id FROM reached GROUP BY doc_id
), counts AS (
  SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT doc_id, n AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM sizes JOIN roots USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op4_warc": OP4_SQL, "op1_cover_tree": OP1_SQL, "op5_mix_sources": OP5_SQL, "op6_chat_tree": OP6_SQL, "op8_ngram_jaccard": OP8_SQL}
