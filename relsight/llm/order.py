"""Places of rows in the order of their group, however many rows one group has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relsight.llm.shared import fresh, written


def placed(rows: DataFrame, group: list[str], order: list[Column], name: str = "placed") -> DataFrame:
    """``rows`` with pos (from 0) in their group, by ``order``, and n, the group's number of rows.

    Rows are dealt by ranges of group and order, so a large group fills
    several ranges; they are written with their place in the range, and only
    counts by group and range meet to make the offsets. Nulls are a group.
    Rows that are equal in all of ``order`` may take each other's place.
    """
    spark = rows.sparkSession
    at = fresh(rows.columns, "at")
    keys = [*[F.col(c).asc_nulls_first() for c in group], *order]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # An id of 2^33 times the range and the row's place in it.
    table = written(rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), name)
    counts = table.groupBy(*group, F.shiftright(at, 33).alias("range_")).agg(F.min(at).alias("first_"), F.count("*").alias("rows_"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("rows_").over(whole.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select(*[F.col(c).alias(f"{c}_g") for c in group], "range_", (before - F.col("first_")).alias("shift_"), F.sum("rows_").over(whole).alias("n"))
    same = F.shiftright(table[at], 33) == F.col("range_")
    for c in group:
        same &= table[c].eqNullSafe(F.col(f"{c}_g"))
    return table.join(shift, same).select(*[table[c] for c in rows.columns], (table[at] + F.col("shift_")).alias("pos"), "n")
