"""Revisions: what each arrival does to the store, the merged state, windows, saturation and checkpoints."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATUSES = ("inserted", "updated", "unchanged")
# Fields that an update replaces, and those that it clears.
REVISION = ["versioned_id", "version", "title", "abstract", "authors", "affiliations", "categories", "primary_category", "published_at", "updated_at", "abs_url", "pdf_url", "doi", "journal_ref", "comment"]
CLEARED = ["pdf_path", "text_path", "last_error"]
NEW_SUBMISSIONS, REVISIONS = "arxiv_submissions", "arxiv_revisions"


def statuses(arrivals: DataFrame, key: str, marks: list[str], order: list[str]) -> DataFrame:
    """status of each arrival in order: inserted for a key's first, unchanged if its marks equal the last one's, else updated.

    A revision that differs counts as an update even if it is older.
    """
    last = F.lag(F.struct(*marks)).over(Window.partitionBy(key).orderBy(*order))
    return arrivals.withColumn("_last", last).withColumn("status", F.when(F.col("_last").isNull(), "inserted").when(F.col("_last") == F.struct(*marks), "unchanged").otherwise("updated")).drop("_last")


def status_counts(with_status: DataFrame) -> DataFrame:
    """A row for each status, zero included."""
    every = with_status.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(with_status.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def latest(arrivals: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last arrival of each key; combined before the shuffle."""
    return arrivals.groupBy(key).agg(F.max_by(F.struct(*(c for c in arrivals.columns if c != key)), F.struct(*order)).alias("r")).select(key, "r.*")


def upsert(papers: DataFrame, batch: DataFrame, order: str = "position", now: str = "seen_at") -> DataFrame:
    """The store after a batch of revisions in order.

    New papers come in. A paper whose versioned id and time stay only gets a new last_seen_at, even if other fields of the
    batch differ. Else all revision fields are replaced, file paths and error cleared, created_at kept. Within a
    batch, a run of equal versions keeps the fields of its first arrival.
    """
    marks = ["versioned_id", "updated_at"]
    own = Window.partitionBy("arxiv_id").orderBy(order)
    old = papers.select("arxiv_id", F.lit(None).cast("long").alias(order), *REVISION, F.col("last_seen_at").alias(now))
    new = batch.select("arxiv_id", F.col(order).cast("long").alias(order), *REVISION, F.col(now).alias(now))
    rows = old.unionByName(new).withColumn("_last", F.lag(F.struct(*marks)).over(own))
    rows = rows.withColumn("changed", F.col("_last").isNull() | (F.col("_last") != F.struct(*marks)))
    place = F.struct(F.coalesce(order, F.lit(-1).cast("long")))
    merged = rows.groupBy("arxiv_id").agg(
        F.max_by(F.struct(*REVISION), F.when(F.col("changed"), place)).alias("r"),
        F.max(now).alias("last_seen_at"),
        F.min(F.when(F.col(order).isNotNull(), F.col(now))).alias("first_seen"),
        F.max(F.when(F.col("changed"), F.coalesce(order, F.lit(-1).cast("long")))).alias("_change"),
    )
    kept = papers.select("arxiv_id", "created_at", *CLEARED)
    out = merged.join(kept, "arxiv_id", "left")
    same = F.col("_change") < 0
    cleared = [F.when(same, F.col(c)).alias(c) for c in CLEARED]
    return out.select("arxiv_id", "r.*", *cleared, F.coalesce("created_at", "first_seen").alias("created_at"), "last_seen_at").select(*papers.columns)


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new over those of old with the same key; of several new ones pass the last only."""
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def save_features(stored: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """The feature store after new rows: each replaces the row of its paper as a whole.

    Of several new rows of a paper the last by `order` counts; without one a paper may have only one.
    """
    last = latest(new, "arxiv_id", [order]) if order else new
    return replace_by_key(stored, last.select(*stored.columns), "arxiv_id")


def set_file(papers: DataFrame, arxiv_id: str, kind: str, path: str) -> DataFrame:
    """Sets the pdf or text path of a paper and clears its error; an unknown id changes nothing."""
    if kind not in ("pdf", "text"):
        raise ValueError("kind must be pdf or text")
    hit = F.col("arxiv_id") == arxiv_id
    return papers.withColumns({f"{kind}_path": F.when(hit, F.lit(path)).otherwise(F.col(f"{kind}_path")), "last_error": F.when(~hit, F.col("last_error"))})


def set_error(papers: DataFrame, arxiv_id: str, error: str) -> DataFrame:
    return papers.withColumn("last_error", F.when(F.col("arxiv_id") == arxiv_id, F.substring(F.lit(error), 1, 1000)).otherwise(F.col("last_error")))


def state_key(base: str, categories: list[str]) -> str:
    """A checkpoint's key: the same for the same set of categories."""
    return f"{base}:{','.join(sorted(set(categories)))}"


def window_start(checkpoint: datetime | None, now: datetime, overlap_hours: int = 24, first_run_hours: int = 24) -> datetime:
    """Reads again from an overlap before the checkpoint, which catches late rows; without one from a first look-back."""
    return checkpoint - timedelta(hours=overlap_hours) if checkpoint else now - timedelta(hours=first_run_hours)


def in_window(submissions: DataFrame, start: datetime, end: datetime, categories: list[str], by: str = "published_at") -> DataFrame:
    """Submissions of any of the categories between two minutes, both included."""
    if not categories:
        raise ValueError("at least one category is needed")
    # Both minutes as bounds of the column itself, so that the scan can skip what lies outside.
    first, after = start.replace(second=0, microsecond=0), end.replace(second=0, microsecond=0) + timedelta(minutes=1)
    inside = (F.col(by) >= F.lit(first)) & (F.col(by) < F.lit(after))
    return submissions.where(inside & F.arrays_overlap("categories", F.array(*map(F.lit, categories))))


def unseen(revisions: DataFrame, submissions: DataFrame) -> DataFrame:
    """Revisions that the submissions of the same run don't have."""
    return revisions.join(submissions.select("versioned_id").distinct(), "versioned_id", "left_anti")


def capped(rows: DataFrame, cap: int, order: list) -> tuple[DataFrame, bool]:
    """The first `cap` rows, and whether there were more. A saturated run keeps its rows and no checkpoint."""
    return rows.orderBy(*order).limit(cap), rows.limit(cap + 1).count() > cap


def advance(state: DataFrame, values: dict[str, datetime], now: datetime) -> DataFrame:
    """The checkpoint table with several keys set at once."""
    spark: SparkSession = state.sparkSession
    return replace_by_key(state, spark.createDataFrame([(k, v, now) for k, v in values.items()], state.schema), "state_key")
