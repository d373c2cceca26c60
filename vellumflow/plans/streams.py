"""Queries that replay a table as a stream; their folders lie in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.plans.registry import query, table
from vellumflow.sources.shared import run_folder
from vellumflow.streaming.revisions import replay, store_of

# Events land in four deliveries by day; every tenth one comes late, with the next delivery.
FILES = 4
_FILE = "least(((day(ts) - 1) // 8)::INTEGER, 3)"
_ARRIVED = f"""
    WITH a AS (SELECT *, least({_FILE} + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, {FILES - 1}) AS file FROM events),
    s AS (SELECT *, lag(event_type) OVER w AS last FROM a WINDOW w AS (PARTITION BY user_id ORDER BY file, ts, event_id)),
    t AS (SELECT *, CASE WHEN last IS NULL THEN 'inserted' WHEN last = event_type THEN 'unchanged' ELSE 'updated' END AS status FROM s)
"""
ARRIVAL = "event_id long, user_id long, event_type string, seen long"


def _micros(time: str) -> Column:
    """Microseconds since the epoch, whatever the session's zone."""
    seconds = F.unix_date(F.col(time).cast("date")).cast("long") * 86_400 + F.hour(time) * 3_600 + F.minute(time) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")


def _replayed(spark, sf_dir) -> DataFrame:
    """The stream's rows, after a run over each delivery as it lands, and one with nothing new. A delivery has as many parts as its tasks."""
    events = table(spark, sf_dir, "events")
    file = F.least(F.floor((F.dayofmonth("ts") - 1) / 8).cast("int"), F.lit(FILES - 1))
    late = F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    arrivals = events.withColumn("file", F.least(file + late, F.lit(FILES - 1))).select("event_id", "user_id", "event_type", _micros("ts").alias("seen"), "file")
    path = run_folder(spark, "replay")

    # Each part of the state costs a Python worker a batch.
    parts = spark.sparkContext.defaultParallelism

    def run() -> None:
        replay(spark, f"{path}/landing", ARRIVAL, "user_id", ["event_type"], "seen", "event_id", f"{path}/out", f"{path}/checkpoint", None, parts).awaitTermination()

    for i in range(FILES):
        arrivals.where(F.col("file") == i).drop("file").write.mode("append").parquet(f"{path}/landing")
        run()
    run()
    return spark.read.schema("key long, place long, id long, status string, kept long, first_seen long, last_seen long").parquet(f"{path}/out")


@query(f"{_ARRIVED} SELECT event_id, user_id, status FROM t")
def stream_status(spark, sf_dir):
    """What each event does to its user's state, as it arrives."""
    return _replayed(spark, sf_dir).select(F.col("id").alias("event_id"), F.col("key").alias("user_id"), "status")


@query(
    f"""{_ARRIVED}
    SELECT user_id, max_by(event_id, (file, ts, event_id)) FILTER (WHERE status <> 'unchanged') AS kept, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen FROM t GROUP BY user_id
    """
)
def stream_store(spark, sf_dir):
    """The store after all arrivals: the event whose fields stay, first and last time."""
    return store_of(_replayed(spark, sf_dir)).withColumnRenamed("key", "user_id")
