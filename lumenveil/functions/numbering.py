"""Exact running numbers inside groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def numbered(df: DataFrame, group: str, order: list[str], out: str = "number", label: str = "numbered") -> DataFrame:
    """df plus 1, 2, 3 ... in each group by the order.

    The rows are sorted by (group, order) over all partitions and written; a row's index in its file, less where
    its group begins there, and the group's rows in earlier files give its number. The table of beginnings
    has a row for each group in each file.
    """
    ranged = written(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order), label)
    spots = ranged.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    first = F.struct(*order)
    blocks = spots.groupBy(group, "_file").agg(F.count("*").alias("_n"), F.min("_row").alias("_low"), F.min(first).alias("_from"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_from", "_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select(F.col(group).alias("_g"), F.col("_file").alias("_f"), "_low", before.alias("_before"))
    joined = spots.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_file") == F.col("_f")))
    return joined.withColumn(out, F.col("_row") - F.col("_low") + F.col("_before") + 1).drop("_file", "_row", "_g", "_f", "_low", "_before")


def cumulated(df: DataFrame, group: str, order: list[str], weight: str, out: str = "upto", label: str = "cumulated") -> DataFrame:
    """df plus the running sum of weight in each group by the order; (group, order) must be unique, else aggregate first."""
    ranged = written(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order), label)
    spots = ranged.select("*", F.col("_metadata.file_name").alias("_file"))
    blocks = spots.groupBy(group, "_file").agg(F.sum(weight).alias("_n"), F.min(F.struct(*order)).alias("_from"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_from", "_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select(F.col(group).alias("_g"), F.col("_file").alias("_f"), before.alias("_before"))
    inside = F.sum(weight).over(Window.partitionBy(group, "_file").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = spots.withColumn("_in", inside).join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_file") == F.col("_f")))
    return joined.withColumn(out, F.col("_in") + F.col("_before")).drop("_file", "_in", "_g", "_f", "_before")
