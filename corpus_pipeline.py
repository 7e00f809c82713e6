"""A training-data pipeline over `documents`: each stage's rows are written as Parquet and read again by the next.

1. language: documents whose language can't be told (no letter, no text) go. With no labelled document at all, only the letter counts.
2. near_duplicates: of each group linked by word shingles at a similarity of 0.8 or more, the smallest id stays.
3. secrets: found secrets are replaced in the text by a mark; no document goes.
4. mixing: sources are brought nearer to equal weights by repeating documents of small sources; every document
   stays at least once.
5. tokens: texts become token ids; the last stage returns ids and digests instead of the columns of documents.

A text that is null counts as empty, and so goes at stage 1. Rows that share an id are separate documents at every
stage but the second, which keeps them together. Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwatt.llm import bpe, language, minhash, mixing, secrets
from fleetwatt.llm.queries import bucket, table
from fleetwatt.llm.text import small_batches
from fleetwatt.session import shared_folder, use_utc

#: Similarity, in percent, from which documents are near duplicates.
SIMILAR = 80

#: Repetition limit of the mixture.
MAX_REPEATS = 1.5


def in_small_batches(stage):
    """The stage, with batches to and from Python bounded by bytes."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language could be told; where no language is known, all that have a letter."""
    held = F.coalesce(bucket("doc_id", 4) == 2, F.lit(False))
    known = language.profiles(docs.filter(F.col("doc_id").isNotNull() & ~held))
    if not known:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    told = docs.select(F.struct(*docs.columns).alias("row"), language.language_column(spark, known, "text").alias("x"))
    return told.filter(F.col("x.lang") != language.UNKNOWN).select("row.*")


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return minhash.deduplicated(docs, SIMILAR)


@in_small_batches
def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of each secret, and their new length."""
    found = secrets.clean_column(spark, secrets.learn(docs), "text")
    rows = docs.select(F.struct(*docs.columns).alias("row"), found.alias("x"))
    new = {"text": F.col("x.text"), "n_chars": F.when(F.col("x.n_secrets") > 0, F.length("x.text").cast("bigint")).otherwise(F.col("row.n_chars"))}
    return rows.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


@in_small_batches
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, those of small sources repeated up to the limit."""
    return mixing.mixed_rows(docs, max_repeats=MAX_REPEATS, budget_x=None)


@in_small_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    automaton = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    return docs.select("doc_id", "source", bpe.round_trip_column(spark, automaton, "text").alias("x")).select("doc_id", "source", "x.*")


STAGES = [("language", languages), ("near_duplicates", near_duplicates), ("secrets", redacted), ("mixing", mixing_stage), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    use_utc(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
