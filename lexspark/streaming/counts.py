"""Running counts over text that keeps coming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import corpus


def line_stream(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """(line) of text files as they come into a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder).select(F.col("value").alias("line"))


def token_counts(lines: DataFrame) -> DataFrame:
    """(word, cnt) so far; the batch operator on a stream, for update or complete mode. Its state grows with the vocabulary alone."""
    return corpus.token_counts(lines)
