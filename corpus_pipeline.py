"""A training-data pipeline over `documents`: five stages, each written as Parquet and read by the next.

STAGES holds (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of documents.

Nulls and ties are the operators': a null text has no language and goes in the
first stage, so later stages meet none unless they are called alone, where it
counts as an empty text; null ids are ids like any other and rank last among
near copies; repeated rows are near copies of each other; an empty table gives
no rows in every stage; columns beyond those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontamination, language_id, line_dedup, near_copies
from lodestone.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now has them."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without text or letters, which have no language; lang becomes the language found."""
    found = language_id.identify(docs, language_id.train(docs))
    return found.filter(F.col("lang_pred") != "und").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines found in ten or more documents out of every text."""
    return _documents(line_dedup.line_dedup(docs).withColumn("text", F.col("kept")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id in each group of near copies: 5-word shingles, similarity 0.8 or more,
    found by SimHash with tries and by bands of minimum hashes."""
    return near_copies.keep_first(docs).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of the benchmark out of every text."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=True)
    return _documents(found.withColumn("text", F.coalesce("clean", "text")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and decoded text."""
    return bpe.encode(docs)


STAGES = [("language_id", known_language), ("line_dedup", without_common_lines), ("near_dedup", one_of_each_group), ("decontamination", without_benchmark), ("bpe", tokens)]
#: Language models, minimum hashes and merges are not to be had in SQL. The operators' tests hold each stage's operator against
#: brute force or the library; run() is held against the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over sf_dir's documents."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
