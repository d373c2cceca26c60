"""What the operators of this subpackage share: row keys, tables in the shared folder, checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many bytes by its counted rows, and joined by a shuffle beyond.
BROADCAST_BYTES = 24 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="vellumflow-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary folder only where no setting names one and all runs in one process, as in local tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = _own_folder()
    return path.rstrip("/")


#: While a table is stored: shuffle files go when it is there, and bucketed tables keep their order when they are read.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings with these values, and as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Tables of one run under the shared folder. drop() removes one that nothing reads any more, close() all of them."""

    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.run = uuid.uuid4().hex
        self.path = f"{scratch_dir(spark)}/vellumflow/{self.run}"
        self.sorted_tables: list[str] = []
        Scratch.opened.append(self)

    def store(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path, schema = f"{self.path}/{name}", df.schema
        with settings(self.spark, WRITING):
            writer = df.write.mode("overwrite")
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def store_sorted(self, df: DataFrame, name: str, keys: list[str], dealt: bool = False) -> DataFrame:
        """A table in buckets of the keys, each one a sorted file: joins by the keys neither shuffle nor sort it.

        dealt: df comes from joins of such tables, so that its partitions are the buckets. (Unions of such tables are
        not safe: where Spark 4.1 reads them by columns it takes their partitions for those of the buckets.)
        """
        table = f"vellumflow_{self.run}_{name}"
        with settings(self.spark, WRITING):
            df = df if dealt else df.repartition(buckets(self.spark), *keys)
            df.sortWithinPartitions(*keys).write.format("parquet").bucketBy(buckets(self.spark), *keys).sortBy(*keys).option("path", f"{self.path}/{name}").saveAsTable(table)
        self.sorted_tables.append(name)
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        if name in self.sorted_tables:
            self.sorted_tables.remove(name)
            self.spark.sql(f"DROP TABLE IF EXISTS vellumflow_{self.run}_{name}")
        self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        for name in list(self.sorted_tables):
            self.drop(name)
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def passing() -> Iterator[None]:
    """Removes in the end the tables of all runs begun inside. Their results have to be stored elsewhere by then."""
    before = len(Scratch.opened)
    try:
        yield
    finally:
        while len(Scratch.opened) > before:
            Scratch.opened.pop().close()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and the row key (_d, _t). Rows with equal id and equal text share a key; all other rows differ."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
    ).select("doc_id", "text", F.xxhash64("doc_id").alias("_d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"))


KEY = ["_d", "_t"]


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str, bytes_per_row: int) -> DataFrame:
    """Joins with right broadcast if its counted rows stay under BROADCAST_BYTES, else by a shuffle, hashing right.

    right has to be cheap to count (a stored table).
    """
    if right.count() * bytes_per_row <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    return join_keyed(left, right, on, how)


def join_keyed(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Joins by a shuffle at every size, hashing right, so that the long rows of left are not sorted."""
    return left.join(right.hint("shuffle_hash"), on, how)


def running(values: Column, combine: Callable[[Column, Column], Column] = lambda x, y: x + y) -> Column:
    """Running sums (or maxima ...) of an array: with each round a place takes in what stands twice as far before it.

    The rounds are as many as the length has bits, so that long arrays take no quadratic time.
    """
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def step(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= back, combine(x, F.get(acc, i - back))).otherwise(x))

    return F.aggregate(rounds, values, step)


def give_back() -> None:
    """Returns the memory that a worker freed to the system, as workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, batch by batch."""

    def run(batches):
        try:
            for batch in batches:
                if batch.num_rows:
                    yield from f(batch)
            batch = None
        finally:
            give_back()

    return df.mapInArrow(run, schema)
