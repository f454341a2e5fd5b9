"""The registered queries of the operators and of the pipeline, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberline.llm import alignment, bpe, dac, exact_dedup, language, packing, quality, rules, sharding, simhash, vector_packing, warc, whitening
from emberline.llm.shared import table

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, capacity=2048)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_files(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=2)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, vector_packing.Limits(tokens=1024, segments=64, loss=1024))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_exact_dedup, op2_sharding, op3_bpe, op4_quality_rules, op5_packing, op6_language_id, op7_token_files, op8_warc, op9_quality_classifier, op10_simhash, op11_embedding_whitening, op12_vector_packing, op13_token_alignment, pipeline]
    return {f.__name__: f for f in own}


_WS = r"[\x20\x09-\x0D]+"

OP1_SQL = f"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""

OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
m AS (SELECT page_id, octet_length(b) AS payload_bytes, unhex(sha1(b)) AS d, max(page_id) OVER (PARTITION BY b) AS last FROM p),
bits AS (SELECT *, hex(d) AS h FROM m),
digits AS (
  SELECT page_id, payload_bytes, last,
         list_transform(range(32), lambda i: ('0x' || substr(h, 5 * (i // 4) + 1, 5))::INT >> (5 * (3 - i % 4)) & 31) AS v
  FROM bits)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM digits
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op8_warc": OP8_SQL}
