"""The bucketed store: which buckets a batch writes, crashes, and runs of fetch()."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vellumflow.operators import upsert
from vellumflow.schemas import PAPERS, STATE
from vellumflow.streaming.ingest import Saturated, Store, fetch

NOW = datetime(2024, 6, 23, 12)


def papers(spark, rows):
    return spark.createDataFrame([dict(arxiv_id=i, versioned_id=f"{i}v{v}", version=v, title=t, categories=["cs.LG"], published_at=p, updated_at=u) for i, v, t, p, u in rows], PAPERS)


def batch(spark, rows, day=1):
    df = papers(spark, [(i, v, t, NOW, NOW) for i, v, t in rows])
    return df.withColumns({"position": F.monotonically_increasing_id(), "seen_at": F.lit(NOW + timedelta(days=day))})


def test_a_batch_writes_its_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=8)
    store.merge(batch(spark, [(f"p{i}", 1, "old") for i in range(200)]))
    first = dict(store._current("papers")["at"])
    assert len(first) == 8
    store.merge(batch(spark, [("p3", 2, "new"), ("q", 1, "new")], 2))
    second = store._current("papers")["at"]
    assert 1 <= sum(second[b] != first[b] for b in first) <= 2
    rows = {r.arxiv_id: r for r in store.papers.collect()}
    assert len(rows) == 201 and rows["p3"].title == rows["q"].title == "new" and rows["p4"].title == "old"
    assert rows["p3"].created_at == NOW + timedelta(days=1) and rows["p3"].last_seen_at == NOW + timedelta(days=2)
    for day in range(3, 8):
        store.merge(batch(spark, [(f"p{i}", day, str(day)) for i in range(200)], day))
    names = store.files.names(f"{store.path}/papers")
    assert sum(n.isdigit() for n in names) <= 3 and sum(n.startswith("list-") for n in names) <= 2
    assert store.papers.where("title = '7'").count() == 200 and store.papers.count() == 201


def test_a_broken_write_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    store.merge(batch(spark, [("a", 1, "one"), ("b", 1, "one")]))

    def stop(*_):
        raise OSError("crash")

    with monkeypatch.context() as m:
        m.setattr(store.files, "rename", stop)
        with pytest.raises(OSError):
            store.merge(batch(spark, [("a", 2, "two")]))
    again = Store(spark, str(tmp_path / "s"))
    assert {r.title for r in again.papers.collect()} == {"one"}
    again.merge(batch(spark, [("a", 2, "two")]))
    assert {r.arxiv_id: r.title for r in again.papers.collect()} == {"a": "two", "b": "one"}


def test_saturated_runs_keep_rows_and_no_checkpoint(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    land = papers(spark, [(f"p{i}", 1, "t", NOW - timedelta(hours=i + 1), NOW - timedelta(hours=i + 1)) for i in range(5)])
    with pytest.raises(Saturated, match="submissions"):
        fetch(store, land, ["cs.LG"], NOW, cap=3)
    assert store.papers.count() == 3 and store.state.count() == 0
    report = fetch(store, land, ["cs.LG"], NOW, cap=5)
    assert (report["inserted"], report["unchanged"]) == (2, 3) and store.state.count() == 2


def test_without_revisions_only_one_checkpoint_moves(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    land = papers(spark, [("a", 2, "t", NOW - timedelta(days=9), NOW - timedelta(hours=1)), ("b", 1, "t", NOW - timedelta(hours=1), NOW - timedelta(hours=1))])
    report = fetch(store, land, ["cs.LG"], NOW, scan_revisions=False)
    assert report["submissions"] == 1 and "revisions" not in report
    assert [r.state_key for r in store.state.collect()] == ["arxiv_submissions:cs.LG"]
    # A row that came late is found again within the overlap.
    late = land.unionByName(papers(spark, [("late", 1, "t", NOW - timedelta(hours=20), NOW - timedelta(hours=20))]))
    report = fetch(store, late, ["cs.LG"], NOW + timedelta(hours=1))
    assert report["window_start"] == NOW - timedelta(hours=24) and store.papers.where("arxiv_id = 'late'").count() == 1
    assert {r.state_value for r in store.state.collect()} == {NOW + timedelta(hours=1)}


def test_setters_of_unknown_papers(spark):
    df = papers(spark, [("a", 1, "t", NOW, NOW)])
    assert upsert.set_error(df, "x", "e").collect() == df.collect() == upsert.set_file(df, "x", "text", "/p").collect()
    assert len(upsert.set_error(df, "a", "e" * 2000).head().last_error) == 1000
    with pytest.raises(ValueError):
        upsert.set_file(df, "a", "html", "/p")
    assert upsert.advance(spark.createDataFrame([], STATE), {"k": NOW}, NOW).count() == 1
