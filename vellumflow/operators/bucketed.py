"""A store in buckets: tables of the catalog whose files are sorted by key, so that a merge shuffles the batch and not the store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.sources.shared import run_folder


class BucketedStore:
    """Rows by a unique key. Every merge writes a new generation, bucket by bucket, and then drops the one before.

    A merge that breaks off leaves the last generation as it was. A new row replaces the stored one as a whole. Rows with a null
    key are never equal to others: they are kept, and added.
    """

    def __init__(self, spark: SparkSession, rows: DataFrame, key: str, buckets: int | None = None):
        self.spark, self.key, self.columns = spark, key, rows.columns
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.generation = f"vellumflow_{uuid.uuid4().hex}", 0
        self.path = run_folder(spark, "bucketed")
        self._write(rows.repartition(self.buckets, key), 0)

    def _table(self, generation: int) -> str:
        return f"{self.name}_{generation}"

    def _write(self, rows: DataFrame, generation: int) -> None:
        writer = rows.sortWithinPartitions(self.key).write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key)
        writer.option("path", f"{self.path}/{generation}").saveAsTable(self._table(generation))

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self._table(self.generation))

    def merged(self, batch: DataFrame) -> DataFrame:
        """The store's rows after a batch of distinct keys."""
        new = batch.select(*self.columns, F.lit(True).alias("_new")).alias("n")
        both = self.rows.alias("o").join(new, F.col(f"o.{self.key}") == F.col(f"n.{self.key}"), "full")
        return both.select(*(F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in self.columns))

    def merge(self, batch: DataFrame) -> None:
        # The join's partitions are the buckets, so that each writes its own file.
        self._write(self.merged(batch), self.generation + 1)
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(self.generation)}")
        self.generation += 1
