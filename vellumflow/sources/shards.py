"""A dataset of claims in shards by date, with a manifest of counts and hashes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.operators.claims import with_claims
from vellumflow.operators.curation import EXCLUDED_PREFIXES
from vellumflow.operators.ranks import ranked
from vellumflow.sources.jsonl import read_papers
from vellumflow.sources.swap import Files, replace_directory

SCHEMA_VERSION = "1.0"


def shard_counts(papers: DataFrame, day: str = "submitted_date") -> DataFrame:
    """For each day: papers, papers with envelopes, envelopes."""
    return papers.groupBy(day).agg(
        F.count(F.lit(1)).alias("paper_count"),
        F.count_if(F.size("validity_envelopes") > 0).alias("with_envelopes"),
        F.sum(F.size("validity_envelopes")).alias("envelopes"),
    )


#: Files up to this size are hashed whole, by one task each.
WHOLE_FILE = 64 << 20
#: Rows of a chunk. A shard's digest gathers one hash for each of its chunks.
CHUNK = 10_000


def file_hashes(spark: SparkSession, folder: str, most: int = WHOLE_FILE) -> DataFrame:
    """file and sha256 of each file under a folder, hashed where the files are read; null for a file of more than `most` bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    # Only the listing of all files is read here, contents of the small ones there.
    listed = files.load(folder).select(name, "length")
    hashed = files.load(folder).where(F.col("length") <= most).select(name, F.sha2("content", 256).alias("sha256"))
    return listed.join(hashed, "file", "left").select("file", "sha256")


def digests(rows: DataFrame, shard: str, order: list[Column], line: Column, chunk: int = CHUNK) -> DataFrame:
    """shard, row_count, chunk_count, sha256: a hash of the hashes of chunks of `chunk` rows in order, each a hash of its rows' hashes.

    Hashes are hexadecimal and joined without a mark. Rows are ranked, hashed and combined on the executors, and no task holds
    more of a shard than its chunks' hashes. A null line is empty.
    """
    hashed = rows.select(F.col(shard), F.sha2(F.coalesce(line, F.lit("")), 256).alias("_h"), *(c.alias(f"_o{i}") for i, c in enumerate(order)))
    places = ranked(hashed, shard, [F.col(f"_o{i}").asc() for i in range(len(order))], ["_h"])
    joined = lambda at, h: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, h))), lambda x: x[h]), ""), 256)
    chunks = places.withColumn("_c", F.floor((F.col("place") - 1) / chunk)).groupBy(shard, "_c").agg(joined("place", "_h").alias("_d"), F.count(F.lit(1)).alias("_n"))
    return chunks.groupBy(shard).agg(F.sum("_n").alias("row_count"), F.count(F.lit(1)).alias("chunk_count"), joined("_c", "_d").alias("sha256"))


def write_claim_shards(spark: SparkSession, source: str, target: str, expected: int | None = None) -> dict:
    """Reads, extracts and writes one shard a day in source order, then swaps the folder in; returns the manifest.

    A failure on any line, or a count other than expected, leaves the old folder as it was. source and target are paths of
    file systems that driver and executors share. Each day's file is written by one task, which sorts on disk where it has to;
    the driver only renames files. Hashes are made on the executors: of whole files up to WHOLE_FILE bytes, of chunks of lines beyond.
    """
    papers = with_claims(read_papers(spark, source)).persist()
    try:
        n = papers.count()
        if expected is not None and n != expected:
            raise ValueError(f"{n} papers, not {expected}")
        # A row for each day.
        counts = {r.submitted_date: r for r in shard_counts(papers).collect()}
        extracted = sum(r.with_envelopes for r in counts.values())
        manifest = {
            "schema_version": SCHEMA_VERSION,
            "paper_count": n,
            "papers_with_envelopes": extracted,
            "papers_without_envelopes": n - extracted,
            "envelope_count": sum(r.envelopes for r in counts.values()),
        }

        def write(stage: str) -> None:
            files = Files(spark, stage)
            names = sorted(c for c in papers.columns if c != "line")
            rows = papers.select("line", F.col("submitted_date").alias("day"), *names)
            dealt = rows.repartition("day").sortWithinPartitions("day", "line").drop("line")
            dealt.write.partitionBy("day").option("maxRecordsPerFile", 0).json(f"{stage}/_parts")
            shards = []
            for day in sorted(counts):
                (part,) = (f for f in files.names(f"{stage}/_parts/day={day}") if f.startswith("part-"))
                files.rename(f"{stage}/_parts/day={day}/{part}", f"{stage}/{day}.jsonl")
                shards.append({"file": f"{day}.jsonl", "paper_count": counts[day].paper_count})
            files.delete(f"{stage}/_parts")
            # A row for each file. What is too large to be hashed whole has a digest of its lines instead.
            hashes = {r.file: r.sha256 for r in file_hashes(spark, stage).unionByName(file_hashes(spark, source)).collect()}
            if None in hashes.values():
                text = F.to_json(F.struct(*names))
                by_day = {f"{r.submitted_date}.jsonl": r.sha256 for r in digests(papers, "submitted_date", [F.col("line")], text).collect()}
                whole = digests(papers.withColumn("_all", F.lit(1)), "_all", [F.col("line")], text).head().sha256
            told = lambda name, chunked: {"sha256": hashes[name]} if hashes[name] else {"chunked_sha256": chunked()}
            shards = [s | told(s["file"], lambda s=s: by_day[s["file"]]) for s in shards]
            own = told(source.rstrip("/").rpartition("/")[2], lambda: whole)
            manifest.update({f"source_{k}": v for k, v in own.items()}, shards=shards)
            files.write(f"{stage}/manifest.json", json.dumps(manifest, indent=2, sort_keys=True) + "\n")

        replace_directory(spark, target, write)
        return manifest
    finally:
        papers.unpersist()


def curation_facts(first: str, last: str, target: int, source_count: int, papers: DataFrame, prefixes: tuple[str, ...] = EXCLUDED_PREFIXES) -> dict:
    """What is told about a curated dataset: its days, and the counts before and after."""
    n = papers.count()
    return {
        "date_range": {"start": first, "end": last, "inclusive": True, "timezone": "UTC"},
        "sort": {"sortBy": "submittedDate", "sortOrder": "ascending"},
        "curation": {"target_paper_count": target, "post_curation_paper_count": n, "removed_paper_count": source_count - n, "excluded_primary_category_prefixes": list(prefixes)},
        "source_paper_count": source_count,
        "paper_count": n,
    }


def write_metadata(spark: SparkSession, path: str, facts: dict) -> None:
    """Facts as JSON with sorted keys."""
    Files(spark, path).write(path, json.dumps(facts, indent=2, sort_keys=True) + "\n")
