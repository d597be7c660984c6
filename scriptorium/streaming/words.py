"""Word counts over a stream of text files: the batch expression, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.operators.lexicon import token_frequency


def text_stream(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    return spark.readStream.option("pathGlobFilter", "*.txt").option("wholetext", True).option("maxFilesPerTrigger", files_at_once).text(path).withColumnRenamed("value", "text")


def token_frequency_stream(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """(word, n) so far. Write it in update or complete mode, with a checkpoint in the shared folder."""
    return token_frequency(text_stream(spark, path, files_at_once))
