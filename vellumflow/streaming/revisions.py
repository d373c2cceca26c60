"""Revisions as a stateful stream: each paper's state lives in the state store, in the slot of the paper's hash.

A micro-batch only reads and writes the slots of the papers that arrive in it, and the checkpoint holds states and offsets
together, so that a restart goes on where the last batch ended and none counts twice. A slot's papers share a call of Python and
their states a value of the state store, as calls for single papers, and values converted one by one, cost more than all else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ValueState

#: Keyed state of any size is kept on disk, and changes to it in the checkpoint.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
TOLD = "place long, id long, status string, kept long, first_seen long, last_seen long"
#: A checkpoint holds for one number of slots.
SLOTS = 1024
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Papers:
    """The states of a slot's papers, kept as one value of arrays."""

    SCHEMA = "keys array<string>, marks array<string>, kept array<long>, first_seen array<long>, last_seen array<long>, arrivals array<long>"

    def __init__(self, value: ValueState):
        self.value = value

    def get(self) -> Iterator[tuple]:
        return zip(*(self.value.get() or ()), strict=True)

    def put(self, rows: list[tuple]) -> None:
        self.value.update(tuple(map(list, zip(*rows, strict=True))))


class Revisions(StatefulProcessor):
    """What each arrival does to its paper. State of a paper: mark, the id of the arrival whose fields stay, first and last time seen, arrivals so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.papers = Papers(handle.getValueState("papers", Papers.SCHEMA))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        # A batch's arrivals of one slot's papers.
        batch = pd.concat(list(rows), ignore_index=True)
        paper, papers = pd.factorize(batch["key"], use_na_sentinel=False)
        no_id, no_seen = (batch["nulls"].to_numpy() & 1) > 0, (batch["nulls"].to_numpy() & 2) > 0
        order = np.lexsort((batch["id"].to_numpy(), no_id, batch["seen"].to_numpy(), no_seen, paper))
        paper, no_id, no_seen = paper[order], no_id[order], no_seen[order]
        ids, seen, mark = (batch[c].to_numpy()[order] for c in ("id", "seen", "mark"))
        n = len(order)
        begins = np.flatnonzero(np.r_[True, paper[1:] != paper[:-1]])
        ends = np.r_[begins[1:], n] - 1

        papers = [None if pd.isna(p) else p for p in papers]
        stored = {p: state for p, *state in self.papers.get()}
        old = [stored.get(p) for p in papers]
        known = np.array([o is not None for o in old])
        marks, kepts, firsts, lasts, counts = zip(*((None, None, None, None, 0) if o is None else o for o in old), strict=True)
        before = np.r_[[None], mark[:-1]]
        before[begins] = marks
        unchanged = (mark == before).astype(bool)
        status = np.where(unchanged, "unchanged", "updated").astype(object)
        status[begins[~known]] = "inserted"
        at = np.arange(n)
        place = at - begins[paper] + 1 + np.array(counts)[paper]

        # The last change so far, or what stayed from before this batch.
        change = np.maximum.accumulate(np.where(unchanged, -1, at))
        earlier = change < begins[paper]
        kept = np.where(earlier, _filled(kepts, 0)[paper], ids[change])
        no_kept = np.where(earlier, _missing(kepts)[paper], no_id[change])
        # Times rise within a paper, those without one come last.
        first = np.minimum(_filled(firsts, _MOST), np.where(no_seen, _MOST, seen)[begins])[paper]
        last = pd.Series(np.where(no_seen, _LEAST, seen)).groupby(paper).cummax().to_numpy()
        last = np.maximum(_filled(lasts, _LEAST)[paper], last)
        no_time = _missing(firsts)[paper] & no_seen[begins][paper]

        out = pd.DataFrame({"key": pd.Series(papers, dtype=object).to_numpy()[paper], "place": place, "id": _longs(ids, no_id), "status": status})
        out = out.assign(kept=_longs(kept, no_kept), first_seen=_longs(first, no_time), last_seen=_longs(last, no_time))
        none = lambda values, missing: [None if m else v for v, m in zip(values[ends].tolist(), missing[ends].tolist(), strict=True)]
        states = zip(mark[ends].tolist(), none(kept, no_kept), none(first, no_time), none(last, no_time), place[ends].tolist(), strict=True)
        stored.update(zip(papers, states, strict=True))
        self.papers.put([(p, *state) for p, state in stored.items()])
        yield out

    def close(self) -> None:
        pass


def _missing(values: tuple) -> np.ndarray:
    return np.array([v is None for v in values])


def _filled(values: tuple, by: int) -> np.ndarray:
    return np.array([by if v is None else v for v in values], np.int64)


def _longs(values: np.ndarray, missing: np.ndarray) -> pd.api.extensions.ExtensionArray:
    return pd.arrays.IntegerArray(values.astype(np.int64), missing.astype(bool))


def revisions(arrivals: DataFrame, key: str, mark: list[str], seen: str, id_col: str) -> DataFrame:
    """A stream of (key, place, id, status, kept, first_seen, last_seen), a row for each arrival of a streaming table.

    A key's first arrival is inserted; one whose marks equal the last one's is unchanged, else updated, also if it is older.
    Arrivals of one micro-batch go in order of `seen` (microseconds) and id, nulls last; what comes in a later batch counts as later. kept
    is the arrival whose fields the store holds after this one, place its number in its key.
    """
    # Longs have no nulls in Python, where they would become floats.
    nulls = F.col(id_col).isNull().cast("int") + F.col(seen).isNull().cast("int") * 2
    rows = arrivals.select(
        F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int").alias("slot"),
        F.col(key).cast("string").alias("key"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        F.coalesce(F.col(seen).cast("long"), F.lit(0)).alias("seen"),
        F.to_json(F.struct(*mark), {"ignoreNullFields": "false"}).alias("mark"),
        nulls.alias("nulls"),
    )
    told = rows.groupBy("slot").transformWithStateInPandas(Revisions(), f"key string, {TOLD}", "append", "none")
    return told.withColumn("key", F.col("key").cast(arrivals.schema[key].dataType))


def replay(
    spark: SparkSession, landing: str, schema: str, key: str, mark: list[str], seen: str, id_col: str, out: str, checkpoint: str, files: int | None = 1, partitions: int | None = None
) -> StreamingQuery:
    """Takes in all new files of a landing folder, so many a micro-batch in order of arrival (None: all in one), and ends.

    partitions is the number of parts of the state, the session's shuffle partitions unless given; a checkpoint keeps that of its first run.
    """
    conf = STATE_STORE | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    reader = spark.readStream.schema(schema)
    arrivals = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(landing)
    told = revisions(arrivals, key, mark, seen, id_col)
    try:
        # A query keeps the settings that it starts with.
        return told.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def store_of(told: DataFrame) -> DataFrame:
    """key, kept, first_seen, last_seen after the last arrival of each key; combined before the shuffle."""
    state = F.max_by(F.struct("kept", "first_seen", "last_seen"), "place")
    return told.groupBy("key").agg(state.alias("s")).select("key", "s.*")
