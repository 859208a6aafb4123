"""Ends of edges and categories of nodes as bucketed tables, which join without moving either.

An end's rows of a predicate are one row with their number, so a hub fills no
bucket. Tables of one number of buckets fit each other; they are made once
and read by any number of counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relsight.operators.shared import delete
from relsight.operators.stats import category_sums, end_counts


def save_bucketed(df: DataFrame, name: str, folder: str, column: str, buckets: int) -> DataFrame:
    """``df`` as a table of the catalogue in ``folder``, bucketed and sorted by a column. One task a bucket writes, so a bucket is one file."""
    rows = df.repartition(buckets, column)
    rows.write.bucketBy(buckets, column).sortBy(column).option("path", f"{folder}/{name}").mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def save_ends(t: DataFrame, end: str, name: str, folder: str, buckets: int) -> DataFrame:
    """p, the end and n of edges (p, s, o), bucketed by the end."""
    return save_bucketed(end_counts(t, end), name, folder, end, buckets)


def save_nodes(nodes: DataFrame, name: str, folder: str, buckets: int) -> DataFrame:
    """node_id and smallest category of nodes, bucketed by the id."""
    return save_bucketed(nodes.groupBy("node_id").agg(F.min("category").alias("category")), name, folder, "node_id", buckets)


def category_counts(ends: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """p, category, count, share from two such tables."""
    return category_sums(ends, nodes, end)


def drop(spark: SparkSession, name: str, folder: str) -> None:
    spark.sql(f"drop table if exists {name}")
    delete(spark, f"{folder}/{name}")
