"""A corpus from documents to packed training sequences, in five stages that each read what the one before has written.

Every stage but the last returns the columns of ``documents``.  Rows are judged one by one or by their own place in the
files, so null doc_ids, rows that share a doc_id and repeated rows take part like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import exact_dedup, files, language, packing, quality, similar
from emberline.llm.shared import few, folder, row_numbers, table, written

#: Below this posterior a language is not trusted; nor is one that leads the next by less than this log probability an
#: n-gram, in texts of so many: such a text is about half in each.
LEAST_LANGUAGE, LEAST_MARGIN, MARGIN_GRAMS = 0.5, 0.05, 50
#: Words of a shingle, and the similarity from which documents are near-duplicates.
NEAR_WORDS, NEAR = 5, 0.8
#: Tables in the shared folder that exact_dedup's result is read from, until the next stage runs on what was written of it.
_SPENT: list[str] = []
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in docs.columns]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one known language: not ``und``, nor doubtful by posterior or by margin."""
    found = language.identify(docs, carry=_columns(docs))
    sure = (F.col("score") >= LEAST_LANGUAGE) & ((F.col("margin") >= LEAST_MARGIN) | (F.col("n_grams") < MARGIN_GRAMS))
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & sure).select(*_columns(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier calls good, at its threshold."""
    return quality.classify(docs, table(spark, sf_dir, "labels"), carry=_columns(docs)).filter("predicted = 1").select(*_columns(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first of each group of equal texts."""
    found = exact_dedup.exact_dedup(docs, carry=_columns(docs))
    if scratch := getattr(found, "_scratch", None):
        _SPENT.append(scratch)
    return found.filter("kept").select(*_columns(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, that with the smallest doc_id (null ids last).

    Near-duplicates have a Jaccard similarity of NEAR or more over shingles of NEAR_WORDS words, or are linked by such.
    SimHash finds the closest of them; what its fingerprints can't tell is found by prefix filtering.
    """
    while _SPENT:  # the stage before has been written by now, as ``docs``
        files.remove(spark, _SPENT.pop())
    rows = row_numbers(docs, _columns(docs))
    near = written(similar.groups(rows, "_node", NEAR_WORDS, NEAR).select(F.col("fp").alias("_node"), "root").join(rows.select("_node", "doc_id"), "_node"), "near-groups")
    first = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_node")).alias("first")).select(F.col("first._node").alias("_node"))
    copies = written(near.select("_node").join(first, "_node", "left_anti"), "near-copies")
    return rows.join(few(copies), "_node", "left_anti").drop("_node")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [("language_id", language_stage), ("quality_classifier", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("packing", packing_stage)]

#: Classifiers, fingerprints and the plan of packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    where = folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}-{name}")
        docs = spark.read.parquet(f"{where}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
