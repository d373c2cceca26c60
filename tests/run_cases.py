"""Cases that write files in a folder and read them again: ingest, streams, shards, sinks, searches, swaps.

What they return is a handful of rows that tell what happened; their files go before they end.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from given import query, values

from vellumflow.schemas import PAPERS
from vellumflow.sources import jsonl, shards
from vellumflow.sources import search as searches
from vellumflow.sources.swap import Files, replace_directory
from vellumflow.streaming.ingest import Saturated, Store, fetch, stream

NOW = datetime(2024, 6, 23, 12)


@contextmanager
def folder(spark: SparkSession) -> Iterator[str]:
    """A folder of one run: in the cluster's shared folder, or a temporary one where no setting names that."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        top = tempfile.gettempdir()
    path = f"{top.rstrip('/')}/vellumflow-run-{uuid.uuid4().hex}"
    files = Files(spark, path)
    files.make(path)
    try:
        yield path
    finally:
        files.delete(path)


def _papers(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    made = [dict(arxiv_id=i, versioned_id=f"{i}v{v}", version=v, title=i, categories=[c], published_at=NOW - timedelta(hours=p), updated_at=NOW - timedelta(hours=u)) for i, v, c, p, u in rows]
    return spark.createDataFrame(made, PAPERS)


LANDING = [("a", 1, "cs.LG", 2, 2), ("b", 1, "cs.LG", 3, 1), ("c", 2, "cs.LG", 216, 5), ("d", 1, "math.CO", 2, 2), ("old", 1, "cs.LG", 300, 299)]


@query(
    values(
        "run submissions revisions inserted updated unchanged papers checkpoints error",
        [
            ("1 capped", None, None, None, None, None, 1, 0, "submissions exceed the cap"),
            ("2 first", 2, 1, 2, 0, 1, 3, 2, None),
            ("3 again", 2, 1, 0, 0, 3, 3, 2, None),
            ("4 newer and late", 3, 1, 1, 1, 2, 4, 2, None),
            ("5 submissions only", 3, None, 0, 0, 3, 4, 2, None),
        ],
    )
)
def ingest_runs(spark, sf_dir):
    """Runs over a landing table: saturation, checkpoints, the overlap that finds late rows, revisions."""
    land = _papers(spark, LANDING)
    # c has a new version; one paper came late, within the overlap.
    later = _papers(spark, [*(r for r in LANDING if r[0] != "c"), ("c", 3, "cs.LG", 216, 0), ("late", 1, "cs.LG", 20, 20)])
    runs = [("1 capped", land, NOW, {"cap": 1}), ("2 first", land, NOW, {}), ("3 again", land, NOW, {}), ("4 newer and late", later, NOW + timedelta(hours=1), {}), ("5 submissions only", later, NOW + timedelta(hours=1), {"scan_revisions": False})]
    told = []
    with folder(spark) as path:
        store = Store(spark, f"{path}/store", buckets=4)
        for name, landing, now, options in runs:
            report, error = {}, None
            try:
                report = fetch(store, landing, ["cs.LG"], now, **options)
            except Saturated as e:
                error = str(e)
            told.append((name, *(report.get(k) for k in ("submissions", "revisions", "inserted", "updated", "unchanged")), store.papers.count(), store.state.count(), error))
    return spark.createDataFrame(told, "run string, submissions long, revisions long, inserted long, updated long, unchanged long, papers long, checkpoints long, error string")


@query(values("step papers versions", [("1 two files", 2, "a1,b1"), ("2 nothing new", 2, "a1,b1"), ("3 a third file", 3, "a2,b1,c1")]))
def stream_runs(spark, sf_dir):
    """New files of a landing folder, each taken once."""
    told = []
    with folder(spark) as path:
        store = Store(spark, f"{path}/store", buckets=4)
        steps = [("1 two files", [[("a", 1, "x", 9, 9)], [("b", 1, "x", 9, 9)]]), ("2 nothing new", []), ("3 a third file", [[("a", 2, "x", 9, 1), ("c", 1, "x", 9, 9)]])]
        for name, files in steps:
            for rows in files:
                _papers(spark, rows).coalesce(1).write.mode("append").parquet(f"{path}/landing")
            stream(spark, f"{path}/landing", store, f"{path}/checkpoint").awaitTermination()
            there = sorted(r.v for r in store.papers.select(F.concat("arxiv_id", F.col("version").cast("string")).alias("v")).collect())
            told.append((name, len(there), ",".join(there)))
    return spark.createDataFrame(told, "step string, papers int, versions string")


def _line(i: int, day: str, abstract: str) -> str:
    return json.dumps({"arxiv_id": str(i), "versioned_id": f"{i}v1", "submitted_date": day, "title": "t", "abstract": abstract})


CLAIM = "We find that heat helps."


@query(
    values(
        "file ids statuses envelopes hash_fits counted",
        [
            ("2026-07-03.jsonl", "1,3", "extracted,no_supported_claim", 1, True, 2),
            ("2026-07-04.jsonl", "2", "extracted", 1, True, 1),
            ("manifest.json", "2 of 3", "1 without", 2, True, 3),
            ("after an error", "kept", "line 2: arxiv_id is repeated", 0, True, 0),
        ],
    )
)
def claim_shards(spark, sf_dir):
    """Shards by day in source order, the manifest, and what a bad line leaves of them."""
    with folder(spark) as path:
        files = Files(spark, path)
        files.write(f"{path}/x.jsonl", "\n".join([_line(1, "2026-07-03", CLAIM), _line(2, "2026-07-04", CLAIM), _line(3, "2026-07-03", "Nothing.")]))
        files.write(f"{path}/bad.jsonl", "\n".join([_line(1, "2026-07-03", CLAIM), _line(1, "2026-07-04", CLAIM)]))
        target = f"{path}/out"
        manifest = shards.write_claim_shards(spark, f"{path}/x.jsonl", target, 3)
        told = []
        for s in manifest["shards"]:
            rows = [json.loads(x) for x in files.read(f"{target}/{s['file']}").splitlines()]
            told.append((s["file"], ",".join(r["arxiv_id"] for r in rows), ",".join(r["status"] for r in rows), sum(len(r["validity_envelopes"]) for r in rows), s["sha256"] == files.sha256(f"{target}/{s['file']}"), s["paper_count"]))
        fits = manifest["source_sha256"] == files.sha256(f"{path}/x.jsonl") and json.loads(files.read(f"{target}/manifest.json")) == manifest
        told.append(("manifest.json", f"{manifest['papers_with_envelopes']} of {manifest['paper_count']}", f"{manifest['papers_without_envelopes']} without", manifest["envelope_count"], fits, manifest["paper_count"]))
        before, error = files.under(target), ""
        try:
            shards.write_claim_shards(spark, f"{path}/bad.jsonl", target)
        except jsonl.BadLine as e:
            error = str(e)
        kept = files.under(target) == before and json.loads(files.read(f"{target}/manifest.json")) == manifest
        told.append(("after an error", "kept" if kept else "lost", error, 0, kept, 0))
    return spark.createDataFrame(told, "file string, ids string, statuses string, envelopes int, hash_fits boolean, counted int")


@query(
    values(
        "kind line content",
        [
            ("json", 1, '{"a":"x","b":"a","n":1}'),
            ("json", 2, '{"a":"é","b":null,"n":2}'),
            ("csv", 1, "date,paper_count"),
            ("csv", 2, "2026-07-03,2"),
            ("csv", 3, "2026-07-04,0"),
            ("metadata", 1, "removed 5 of 12"),
        ],
    )
)
def written_files(spark, sf_dir):
    """Lines with sorted keys in order, counts with a header, and the facts of a curation."""
    told = []
    with folder(spark) as path:
        files = Files(spark, path)
        jsonl.write_lines(spark.createDataFrame([(2, None, "é"), (1, "a", "x")], "n int, b string, a string"), f"{path}/json", ["n"])
        jsonl.write_counts(spark.createDataFrame([("2026-07-04", 0), ("2026-07-03", 2)], "date string, paper_count int"), f"{path}/csv")
        for kind in ("json", "csv"):
            text = "".join(files.read(f"{path}/{kind}/{f}") for f in files.under(f"{path}/{kind}"))
            told += [(kind, i, line) for i, line in enumerate(text.splitlines(), 1)]
        shards.write_metadata(spark, f"{path}/metadata.json", shards.curation_facts("2026-07-03", "2026-07-15", 9, 12, spark.range(7)))
        facts = json.loads(files.read(f"{path}/metadata.json"))
        told.append(("metadata", 1, f"removed {facts['curation']['removed_paper_count']} of {facts['source_paper_count']}"))
    return spark.createDataFrame(told, "kind string, line int, content string")


@query(values("step content", [("1 written", "one"), ("2 replaced", "two"), ("3 failed", "two"), ("4 recovered", "two")]))
def swapped_folder(spark, sf_dir):
    """A folder replaced as a whole, a failed replacement, and a crash in the middle of one."""
    told = []
    with folder(spark) as path:
        files, target = Files(spark, path), f"{path}/out"
        put = lambda text: lambda stage: files.write(f"{stage}/a.txt", text)

        def broken(stage: str) -> None:
            put("three")(stage)
            raise ValueError

        for step, write in (("1 written", put("one")), ("2 replaced", put("two")), ("3 failed", broken)):
            try:
                replace_directory(spark, target, write)
            except ValueError:
                pass
            told.append((step, files.read(f"{target}/a.txt")))
        files.rename(target, f"{path}/.out.backup")
        try:
            replace_directory(spark, target, broken)
        except ValueError:
            pass
        told.append(("4 recovered", files.read(f"{target}/a.txt")))
    return spark.createDataFrame(told, "step string, content string")


@query(values("sort n first last over", [("ascending", 121, "0000", "0120", True), ("descending", 250, "0000", "0249", False)]))
def search_pages(spark, sf_dir):
    """Pages of a search up to one row beyond the cap, which tells that there are more."""
    spark.sparkContext.addPyFile(str(Path(__file__).parent / "fake_search.py"))
    out = None
    for sort, order, cap in (("ascending", searches.SUBMITTED, 120), ("descending", searches.UPDATED, 500)):
        found = searches.search(spark, "fake_search:client", searches.search_query(["cs.LG"]), cap, order, 0)
        df = found.agg(F.lit(sort).alias("sort"), F.count(F.lit(1)).alias("n"), F.min("arxiv_id").alias("first"), F.max("arxiv_id").alias("last")).withColumn("over", F.col("n") > cap)
        out = df if out is None else out.unionByName(df)
    return out
