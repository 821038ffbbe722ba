"""From raw documents to packed sequences: quality rules, near duplicates, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import jaccard, packing, quality, scratch, suffixes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of the shortest passage that goes where it repeats.
REPEAT_WORDS = 51


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs.select(COLUMNS))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.75 and more) the document with the least id stays."""
    return jaccard.keep_one(docs.select(COLUMNS))


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur twice go, in all their places; a document keeps its other text."""
    cut = suffixes.remove_repeats(docs.select(COLUMNS), words=REPEAT_WORDS, keep_text=True, with_row=True)
    return cut.select("doc_id", F.col("kept_text").alias("text"), "row.lang", "row.source", F.char_length("kept_text").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=2048, end_id=0)


STAGES = [("quality rules", quality_stage), ("n-gram Jaccard join", near_duplicate_stage), ("suffix-array dedup", repeat_stage), ("best-fit packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each on the written rows of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
