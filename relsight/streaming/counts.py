"""Predicate counts of a stream of N-Triples lines, kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relsight.sources.readers import triples


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder)


def predicate_counts(lines: DataFrame) -> DataFrame:
    """predicate and count; the state is one number a predicate. Write it in update or complete mode."""
    return triples(lines).groupBy(F.col("p").alias("predicate")).agg(F.count("*").alias("count"))
