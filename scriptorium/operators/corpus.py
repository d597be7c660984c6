"""Cleaning a text corpus and taking stock of its characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T

SEPARATOR = "\n\n<doc>\n\n"


def cleaned(text: Column) -> Column:
    """Without tags and bracketed notes, white space collapsed. What stands between script or style tags stays, as do entities."""
    return T.collapse_blanks(T.strip_notes(T.strip_tags(text)))


def clean_corpus(files: DataFrame, text_col: str = "text", over: int = 100) -> DataFrame:
    """``files`` with their cleaned text, where it has more than ``over`` characters."""
    return files.withColumn(text_col, cleaned(F.col(text_col))).filter(F.length(text_col) > over)


def corpus_summary(files: DataFrame, text_col: str = "text") -> DataFrame:
    n = F.length(text_col)
    return files.agg(F.count(text_col).alias("files"), F.coalesce(F.sum(n), F.lit(0)).alias("chars"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


def char_inventory(files: DataFrame, text_col: str = "text") -> DataFrame:
    """(character, n), line ends included, most frequent first."""
    counts = files.select(F.explode(F.split(F.col(text_col), "")).alias("character")).filter("character <> ''").groupBy("character").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "character")


def char_totals(files: DataFrame, text_col: str = "text") -> DataFrame:
    return char_inventory(files, text_col).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("unique_characters"))


def validation_sample(files: DataFrame, key: str, text_col: str = "text", size: int = 500, most: int = 10) -> DataFrame:
    """(key, chunk, text): a sample for judging tokenizers, the first ``most`` slices of ``size`` characters of each file."""
    return files.select(key, F.posexplode(T.first_slices(F.col(text_col), size, most)).alias("chunk", "text"))


def chunk_text(files: DataFrame, key: str, text_col: str = "text", size: int = 500) -> DataFrame:
    """(key, chunk, text): all slices of ``size`` characters of each file."""
    return files.select(key, F.posexplode(T.slices(F.col(text_col), size)).alias("chunk", "text"))


def unified(files: DataFrame, order: str, text_col: str = "text", separator: str = SEPARATOR) -> DataFrame:
    """One row, the whole corpus as one text in order: for a corpus that is to be one file."""
    return files.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text_col))), lambda r: r[text_col]), separator).alias("text"))
