"""A training corpus from raw documents: toxic ones go, repeated lines go, one of each group of near-duplicates
stays, personal data is masked, and what is left is packed into sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import line_dedup, packing, pii, simhash, toxicity
from spanveil.llm.queries import word_tokenizer
from spanveil.sources.workspace import staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    sized = docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in columns else docs
    return sized.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression, fitted on labelled documents, doesn't reject."""
    model = toxicity.fit_from_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one repeats to within a word."""
    return _with_text(line_dedup.drop_repeated_lines(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: three-word shingles, three bits at most."""
    return simhash.keep_one(docs, words=3, bits=3)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return _with_text(pii.redact(docs, pii.fit(docs)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left into sequences of 2048 tokens."""
    return packing.pack(docs, word_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", near_dedup),
    ("pii", mask_personal_data),
    ("packing", pack),
]

# Tokenising and trained models have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
