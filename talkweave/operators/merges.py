"""Small merges between extraction results and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from talkweave.operators.substring import contains_join


def rename_extractions(extractions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Extraction rows (stem) with the id of the first session whose name contains the stem."""
    needles = extractions.select(F.col("stem").alias("needle_id"), F.col("stem").alias("needle")).distinct()
    texts = sessions.select(F.col("session_id").alias("text_id"), F.col("session_id").alias("text")).distinct()
    first = contains_join(needles, texts).groupBy("needle_id").agg(F.min("text_id").alias("session_id"))
    return extractions.join(first.withColumnRenamed("needle_id", "stem"), "stem")
