"""From raw documents to token ids: quality, exact copies, near copies, mixing, tokens.

Each stage reads what its predecessor wrote. Its result is the table of what it kept; all but the last keep the columns
of ``documents``. Every stage takes nulls, empty and very long texts, repeated rows, empty tables and further columns as
the operator it calls says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.bpe import bpe_round_trip
from scriptorium.llm.exact_dedup import exact_dedup
from scriptorium.llm.mixing import mixed_documents
from scriptorium.llm.quality import quality_filter
from scriptorium.llm.simhash import simhash_dedup
from scriptorium.runtime import Cut, read


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier, trained on ``labels``, rejects; null texts go too."""
    return quality_filter(docs, read(spark, sf_dir, "labels"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of equal texts."""
    return exact_dedup(docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies."""
    return simhash_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws as many blocks as the corpus has, by tempered source weights: a row for each document's part of a drawn block."""
    return mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with their number and whether they decode to the text."""
    return bpe_round_trip(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", keep_one_copy),
    ("SimHash near-dedup", keep_one_near_copy),
    ("mixing sources", mix_sources),
    ("BPE encoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        now = Cut(stage(spark, docs, sf_dir), "stage")
        if before:
            before.drop()
        docs, before = now.df, now
    return STAGES[-1][1](spark, docs, sf_dir)


#: Sketches, regression and seeded draws have no SQL form; the tests compare run() with brute force.
ORACLE_SQL = None
