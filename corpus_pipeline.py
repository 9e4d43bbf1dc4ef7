"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

language: documents without a determined language, or with a confidence under LEAST_LANGUAGE, go.
quality: documents that the quality classifier scores under its threshold go.
near_duplicates: one document of each class of the n-gram Jaccard join stays.
mix: sources are mixed to their target weights; a document that the mix takes twice is there twice.
tokens: every document is encoded and decoded; the result has its token count and digests of ids and text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillwork.llm import bpe, langid, mixing, ngram_join, quality
from rillwork.llm.common import materialize
from rillwork.llm.queries import table, tokenizer_path

LEAST_LANGUAGE = 0.2

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, least=LEAST_LANGUAGE)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("quality", good), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens),
]

#: The stages learn models and join on similarity, which SQL can't express; tests hold each against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
