"""A training-data pipeline of five stages over ``documents``.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
``run`` writes as Parquet in the shared folder and rereads as the next one's docs. All but the last
return the columns of documents. An empty table goes through as an empty one.

doc_id is the documents' key. Rows that repeat an id with the same text are one after the second stage;
with different texts they go or stay together in the other stages. A row without an id is judged by its own
text, and is no near copy of anything. Null and empty texts have no language and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import exact_dedup, language_id, near_dedup, sentencepieces, spaced_seeds
from gazette.llm.queries import vocabulary
from gazette.llm.rows import without_found
from gazette.shared import materialize, read_table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without any letter go."""
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return without_found(docs, lambda rows: language_id.identify(rows, model).where(F.col("lang_pred") == language_id.UNKNOWN))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the one with the smallest doc_id."""
    return near_dedup.drop_near_copies(docs, near_dedup.Rule(words=5, percent=80))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return spaced_seeds.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    return sentencepieces.encode_documents(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("sentencepiece", encoded),
]

#: Kernels, registers, seeds and the tokenizer are beyond SQL; tests hold the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
