"""Incremental ingest: batches of revisions, read from a landing folder, upserted with checkpoints that survive a crash."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from vellumflow.operators.upsert import NEW_SUBMISSIONS, REVISIONS, advance, capped, in_window, state_key, status_counts, statuses, unseen, upsert, window_start
from vellumflow.schemas import PAPERS, STATE
from vellumflow.sources.swap import Files


class Store:
    """Papers in buckets of their key, and state, under a folder.

    A batch writes only the buckets that it touches, as a new generation, and then a list of the generation in which
    each bucket stands. The latest list counts, so a crash leaves the store as it was. Generations that neither the
    latest list nor the one before it names are removed.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)
        self._buckets = buckets

    def _lists(self, table: str) -> list[int]:
        folder = f"{self.path}/{table}"
        names = self.files.names(folder) if self.files.exists(folder) else []
        return sorted(int(n.removeprefix("list-").removesuffix(".json")) for n in names if n.startswith("list-") and n.endswith(".json"))

    def _list(self, table: str, n: int) -> dict:
        return json.loads(self.files.read(f"{self.path}/{table}/list-{n}.json"))

    def _current(self, table: str) -> dict:
        lists = self._lists(table)
        return self._list(table, lists[-1]) if lists else {"buckets": self._buckets if table == "papers" else 1, "at": {}}

    def read(self, table: str, schema: str, only: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        at = {int(b): n for b, n in self._current(table)["at"].items()}
        paths = [f"{self.path}/{table}/{n}/bucket={b}" for b, n in sorted(at.items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, table: str, df: DataFrame, touched: list[int] | None = None) -> None:
        """Puts df, which has a column `bucket`, in the place of the touched buckets."""
        current, lists = self._current(table), self._lists(table)
        n = (lists[-1] if lists else 0) + 1
        # What a broken-off write left under this number goes.
        df.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/{n}")
        there = {int(x.removeprefix("bucket=")) for x in self.files.names(f"{self.path}/{table}/{n}") if x.startswith("bucket=")}
        at = {b: g for b, g in current["at"].items() if int(b) not in set(touched or [])} | {str(b): n for b in there}
        listed = f"{self.path}/{table}/list-{n}.json"
        self.files.write(f"{listed}.new", json.dumps({"buckets": current["buckets"], "at": at}, sort_keys=True))
        self.files.rename(f"{listed}.new", listed)
        for old in lists[:-1]:
            self.files.delete(f"{self.path}/{table}/list-{old}.json")
        used = set(at.values()) | set(current["at"].values())
        for name in self.files.names(f"{self.path}/{table}"):
            if name.isdigit() and int(name) not in used and int(name) < n:
                self.files.delete(f"{self.path}/{table}/{name}")

    papers = property(lambda self: self.read("papers", PAPERS))
    state = property(lambda self: self.read("state", STATE))

    def set_state(self, state: DataFrame) -> None:
        self.write("state", state.withColumn("bucket", F.lit(0)), [0])

    def merge(self, batch: DataFrame) -> None:
        """Upserts a batch into the buckets of its papers."""
        bucket = F.pmod(F.xxhash64("arxiv_id"), F.lit(self._current("papers")["buckets"])).cast("int")
        # As many rows as there are buckets, at most.
        touched = sorted(r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect())
        if touched:
            merged = upsert(self.read("papers", PAPERS, touched), batch)
            self.write("papers", merged.withColumn("bucket", bucket), touched)


class Saturated(RuntimeError):
    """More rows than the cap; the first ones are stored, no checkpoint is set."""


def fetch(store: Store, landing: DataFrame, categories: list[str], now: datetime, cap: int = 100, overlap_hours: int = 24, first_run_hours: int = 24, scan_revisions: bool = True) -> dict:
    """One run: new submissions of the window, then revisions since the cutoff, then both checkpoints at once.

    landing has store rows. Rows already seen among submissions aren't stored again as revisions, but count
    towards the cap. Rows stored before a failure stay; checkpoints only move when everything is in.
    """
    state = {r.state_key: r.state_value for r in store.state.collect()}
    keys = [state_key(k, categories) for k in (NEW_SUBMISSIONS, REVISIONS)]
    start = window_start(state.get(keys[0]), now, overlap_hours, first_run_hours)
    found = in_window(landing, start, now, categories)
    rows, over = capped(found, cap, [F.col("published_at"), F.col("versioned_id")])
    counts = _take(store, rows, now, ["published_at", "versioned_id"])
    if over:
        raise Saturated("submissions exceed the cap")
    report = {"window_start": start, "window_end": now, "submissions": sum(counts.values()), **counts}
    done = {keys[0]: now}
    if scan_revisions:
        cutoff = window_start(state.get(keys[1]), now, overlap_hours, first_run_hours)
        recent = landing.where((F.col("updated_at") >= F.lit(cutoff)) & F.arrays_overlap("categories", F.array(*map(F.lit, categories))))
        newest, over = capped(recent, cap, [F.col("updated_at").desc(), F.col("versioned_id")])
        more = _take(store, unseen(newest, rows), now, [F.col("updated_at").desc(), "versioned_id"])
        if over:
            raise Saturated("revisions exceed the cap")
        report |= {"revision_start": cutoff, "revisions": sum(more.values())} | {k: report[k] + v for k, v in more.items()}
        done[keys[1]] = now
    store.set_state(advance(store.state, done, now))
    return report


def _take(store: Store, rows: DataFrame, now: datetime, order: list) -> dict[str, int]:
    """Upserts capped rows in order and counts what they did."""

    batch = rows.withColumn("position", F.row_number().over(Window.partitionBy("arxiv_id").orderBy(*order)).cast("long")).withColumn("seen_at", F.lit(now))
    old = store.papers.join(batch.select("arxiv_id").distinct(), "arxiv_id", "left_semi").select("arxiv_id", "versioned_id", "updated_at", F.lit(0).cast("long").alias("position"))
    arrivals = old.unionByName(batch.select(*old.columns))
    told = statuses(arrivals, "arxiv_id", ["versioned_id", "updated_at"], ["position"]).where("position > 0")
    counts = {r.status: r.n for r in status_counts(told).collect()}
    store.merge(batch)
    return counts


def stream(spark: SparkSession, landing: str, store: Store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Upserts every new file of the landing folder, batch by batch; applying a batch twice changes nothing more."""

    rows = spark.readStream.schema(PAPERS).parquet(landing)

    def apply(batch: DataFrame, batch_id: int) -> None:
        order = Window.partitionBy("arxiv_id").orderBy("updated_at", "versioned_id")
        store.merge(batch.withColumn("position", F.row_number().over(order).cast("long")).withColumn("seen_at", F.current_timestamp()))

    writer = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
