"""The corpus pipeline: five stages from raw documents to packed sequences.

Every stage works on all that the one before kept; its table is written to the shared
folder and reread, so no stage is computed twice and a lost executor costs rereading only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import line_dedup, mixing, packing, quality, simhash
from newsloom.llm.common import materialize
from newsloom.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that are too frequent on their host."""
    return quality.clean(docs)


def line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go."""
    return line_dedup.strip_repeated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays."""
    return simhash.keep_one(docs, similarity=0.8, shingle=5)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as their source's repetition rate asks."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048."""
    return packing.pack(docs, vocabulary(), 2048)


STAGES = [
    ("quality", quality_rules),
    ("line_dedup", line_windows),
    ("simhash", near_duplicates),
    ("mixing", target_mix),
    ("packing", packed),
]

#: Fingerprints (XXH64) and token ids are beyond SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
