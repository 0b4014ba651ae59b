"""From raw documents to packed training sequences: each stage works on what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a table that is written as
Parquet and read again as the next stage's documents. All but the last return
the columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from findrift.llm import jaccard, packing, rules, toxicity
from findrift.llm.kneser_ney import remainder
from findrift.llm.store import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the production policy of the quality rules."""
    return rules.keep(docs, rules.PRODUCTION)


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labels does not predict to be toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(remainder("doc_id", 4) != 2))
    return toxicity.reject(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of least id."""
    return jaccard.one_of_each(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.sequences(docs, vocabulary, public_tokenizers.PATTERN).drop("cost")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", nontoxic),
    ("near_duplicates", distinct),
    ("packing", sequences),
]

# The trained stage has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
