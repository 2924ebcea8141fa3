"""Extraction on a stream of texts: stateless, row by row, the same plan as in a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import extract_invoices


def invoices_from_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming frame of invoices of the text files that arrive in a folder."""
    texts = spark.readStream.format("text").option("wholetext", True).load(folder)
    return extract_invoices(texts.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"), F.col("value").alias("text")))
