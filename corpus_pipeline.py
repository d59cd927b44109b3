"""From raw documents to packed sequences: quality rules, quality classifier, near-duplicates, repeated
passages, packing. Each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.label_model import good_documents
from graphloom.llm.order_minhash import without_near_duplicates
from graphloom.llm.packing import pack
from graphloom.llm.passages import passages, without_passages
from graphloom.llm.quality_rules import passing
from graphloom.staging import stage

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passing(docs)


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document that has a passage keeps it; ``n_chars`` follows the text."""
    left = without_passages(docs, stage(passages(docs)).df)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, TOKENIZER)


STAGES = [
    ("quality_rules", keep_by_rules),
    ("quality_classifier", keep_by_classifier),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the classifier nor the alignments; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir)).df
    return STAGES[-1][1](spark, docs, sf_dir)
