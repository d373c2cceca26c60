"""Exact ranks within groups of any size, without a task that holds a group.

Rows are dealt by ranges of group and order, whose borders Spark samples, and sorted within them. A row's rank is its place in its
range and what earlier ranges hold of its group: a number for each group and range, which is all that is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.sources.shared import run_folder

#: Bytes of counts up to which they are broadcast.
COUNTS_BYTES = 16 << 20
#: Bits of a row's number within its partition.
ROW_BITS = 33


def ranked(rows: DataFrame, group: str, order: list[Column], keep: list[str]) -> DataFrame:
    """keep, group and `place`, from 1 in each group by `order`; equal rows have different places.

    Null groups are a group. The dealt rows are stored in the shared folder once, so that counts and places are of the same
    rows, also when a lost executor's work is done again.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    path = run_folder(spark, "ranks")
    dealt.select(*keep, group, F.monotonically_increasing_id().alias("_at")).write.parquet(path)
    stored = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", ROW_BITS))
    counts = stored.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # A row for each group and range: as many as there are groups and partitions together, at most.
    earlier = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_range"), "_first", F.coalesce(earlier, F.lit(0)).alias("_before"))
    small = offsets.count() * 64 <= COUNTS_BYTES
    there = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_range"))
    placed = stored.join(F.broadcast(offsets) if small else offsets, there)
    return placed.select(*keep, group, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("place"))
