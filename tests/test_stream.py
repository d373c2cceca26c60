"""The stateful stream: restarts, late arrivals, equal marks, null marks."""

import json
import random
from pathlib import Path

import pandas as pd

from vellumflow.plans import streams
from vellumflow.streaming.revisions import Revisions, replay, store_of

SCHEMA = "id long, paper string, version string, size int, seen long"


def test_restarts_change_nothing(spark, tmp_path):
    path = str(tmp_path)
    told = lambda: spark.read.schema("key string, place long, id long, status string, kept long, first_seen long, last_seen long").parquet(f"{path}/out")

    def land(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/landing")

    def run():
        replay(spark, f"{path}/landing", SCHEMA, "paper", ["version", "size"], "seen", "id", f"{path}/out", f"{path}/checkpoint").awaitTermination()
        return sorted((r.key, r.place, r.id, r.status, r.kept) for r in told().collect())

    land([(1, "a", "v1", 1, 10), (3, "a", "v1", 1, 30), (2, "a", "v2", 1, 20), (4, "b", None, None, 5)])
    first = run()
    assert first == [("a", 1, 1, "inserted", 1), ("a", 2, 2, "updated", 2), ("a", 3, 3, "updated", 3), ("b", 1, 4, "inserted", 4)]
    assert run() == first
    # An older arrival that comes late is one more arrival; equal nulls are equal marks.
    land([(5, "a", "v1", 1, 1), (6, "b", None, None, 6), (7, "c", "v9", None, 7), (8, "b", "v1", None, 6)])
    second = run()
    assert second == sorted([*first, ("a", 4, 5, "unchanged", 3), ("b", 2, 6, "unchanged", 4), ("b", 3, 8, "updated", 8), ("c", 1, 7, "inserted", 7)])
    assert run() == second
    assert sorted(map(tuple, store_of(told()).collect())) == [("a", 3, 1, 30), ("b", 8, 5, 6), ("c", 7, 7, 7)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def brute(batches):
    """What replay tells of batches of (id, paper, version, size, seen)."""
    states, told = {}, []
    for rows in batches:
        for i, paper, version, size, seen in sorted(rows, key=lambda r: (r[4] is None, r[4] or 0, r[0] is None, r[0] or 0)):
            mark, old = (version, size), states.get(paper)
            n, last, kept, first, latest = old or (0, None, None, None, None)
            status = "inserted" if old is None else "unchanged" if last == mark else "updated"
            times = [t for t in (first, latest, seen) if t is not None]
            states[paper] = (n + 1, mark, kept if status == "unchanged" else i, min(times, default=None), max(times, default=None))
            told.append((paper, n + 1, i, status, *states[paper][2:]))
    return told


def test_batches_against_brute_force(spark, tmp_path):
    # Nulls in every column, longs that no float holds, and a batch whose rows lie in several files.
    path, rng, big = str(tmp_path), random.Random(5), 2**53
    batches, n = [], 0
    for _ in range(3):
        rows = []
        for _ in range(300):
            n += 1
            paper = rng.choice([None, "", *(f"p{i}" for i in range(40))])
            rows.append((None if paper is None and n % 50 == 0 else big + n, paper, rng.choice([None, "v1", "v2"]), rng.choice([None, 1]), rng.choice([None, *(big + i for i in range(200))])))
        # Two rows without an id are never of the same paper and time.
        rows = list({(r[1], r[4]) if r[0] is None else r[0]: r for r in rows}.values())
        batches.append(rows)
        spark.createDataFrame(rows, SCHEMA).repartition(5).write.mode("append").parquet(f"{path}/landing")
        replay(spark, f"{path}/landing", SCHEMA, "paper", ["version", "size"], "seen", "id", f"{path}/out", f"{path}/checkpoint", None, 3).awaitTermination()
    got = spark.read.schema("key string, place long, id long, status string, kept long, first_seen long, last_seen long").parquet(f"{path}/out")
    text = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert text(got.collect()) == text(brute(batches))


def test_papers_share_calls_of_the_state():
    class Papers:
        calls, rows = [], []

        def get(self):
            self.calls.append("get")
            return iter(self.rows)

        def put(self, rows):
            self.calls.append("put")
            self.rows = rows

    slot = Revisions()
    slot.papers = Papers()
    rows = pd.DataFrame({"key": [f"p{i % 500}" for i in range(2000)], "id": range(2000), "seen": range(2000), "mark": "m", "nulls": 0})
    out = pd.concat(slot.handleInputRows((0,), iter([rows[:900], rows[900:]]), None))
    assert Papers.calls == ["get", "put"] and len(slot.papers.rows) == 500
    assert out["status"].value_counts().to_dict() == {"unchanged": 1500, "inserted": 500}


def test_deliveries_have_a_part_for_each_task(spark, tmp_path, monkeypatch):
    rows = [(i, f"2024-01-{1 + i % 30:02d} 00:00:0{i % 10}", i % 7, "abc"[i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", streams.F.col("ts").cast("timestamp_ntz"))
    df.repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(streams, "run_folder", lambda spark, name: f"{tmp_path}/{name}")
    with_conf = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "8k"}
    for k, v in with_conf.items():
        spark.conf.set(k, v)
    try:
        assert streams.stream_status(spark, str(tmp_path)).count() == 600
    finally:
        for k in with_conf:
            spark.conf.unset(k)
    batches = [f for f in Path(f"{tmp_path}/replay/checkpoint/sources/0").iterdir() if f.name.isdigit()]
    assert [len(f.read_text().splitlines()) - 1 for f in sorted(batches)] == [6] * 4
    assert all(json.loads(line)["path"] for f in batches for line in f.read_text().splitlines()[1:])


def test_states_of_a_slot_are_one_value():
    class Value:
        held, updates = None, 0

        def get(self):
            return self.held

        def update(self, held):
            self.held, self.updates = held, self.updates + 1

    class Handle:
        value = Value()

        def getValueState(self, name, schema):
            return self.value

    slot, handle = Revisions(), Handle()
    slot.init(handle)
    rows = pd.DataFrame({"key": [None, *(f"p{i % 99}" for i in range(999))], "id": range(1000), "seen": range(1000), "mark": "m", "nulls": [3, *[0] * 999]})
    one, two = (pd.concat(slot.handleInputRows((0,), iter([part]), None)) for part in (rows[:500], rows[500:]))
    assert handle.value.updates == 2 and [len(column) for column in handle.value.held] == [100] * 6
    assert one["status"].value_counts().to_dict() == {"unchanged": 400, "inserted": 100} and set(two["status"]) == {"unchanged"}
    assert dict(zip(handle.value.held[0], zip(*handle.value.held[2:], strict=True), strict=True))[None] == (None, None, None, 1)


def test_times_in_any_zone(spark):
    times = ["1969-12-31 23:59:59.999999", "1970-01-01 00:00:00", "2024-03-31 02:30:01.000001", "2024-12-31 23:59:59.5", "1582-10-04 12:34:56.789012", None]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        df = spark.createDataFrame([(t,) for t in times], "ts string").select(streams.F.col("ts").cast("timestamp_ntz").alias("ts"))
        got = [r[0] for r in df.select(streams._micros("ts")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    epoch = pd.Timestamp(0).to_pydatetime()
    want = [None if t is None else (pd.Timestamp(t).to_pydatetime() - epoch) // pd.Timedelta(microseconds=1).to_pytimedelta() for t in times]
    assert got == want
