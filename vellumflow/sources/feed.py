"""Atom feeds in a landing folder: entries to papers, completeness, error entries, client results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.functions.text import feed_id, split_version, squeeze
from vellumflow.schemas import PAPERS

LINK = "struct<_href:string,_rel:string,_title:string,_type:string>"
ENTRY = (
    f"id string, title string, summary string, published string, updated string, author array<struct<name:string,affiliation:array<string>>>, "
    f"link array<{LINK}>, category array<struct<_term:string>>, primary_category struct<_term:string>, "
    "comment string, journal_ref string, doi string"
)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Raw entries of the feed files under a path; prefixes of names are dropped by the reader."""
    return spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", "true").schema(ENTRY).load(path)


def feed_total(spark: SparkSession, path: str) -> int:
    """What the first page of a feed says its number of results is."""
    rows = spark.read.format("xml").option("rowTag", "feed").option("ignoreNamespace", "true").schema("totalResults long").load(path)
    return rows.agg(F.max("totalResults")).head()[0] or 0


def check_feed(entries: DataFrame, total: int) -> DataFrame:
    """The entries, if they are as many as announced and no error report."""
    found = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.trim("title")).alias("title"), F.max("summary").alias("said")).head()
    if found.n == 1 and found.title == "Error":
        raise ValueError(f"the feed reports an error: {found.said}")
    if found.n != total:
        raise ValueError(f"the feed has {found.n} of {total} entries")
    return entries


def _paper_columns() -> list[Column]:
    ids = feed_id("id")
    pick = lambda test: F.try_element_at(F.filter("link", test), F.lit(-1))["_href"]
    optional = lambda c: F.nullif(squeeze(c), F.lit("")).alias(c)
    return [
        ids["base"].alias("arxiv_id"),
        ids["versioned"].alias("versioned_id"),
        squeeze("title").alias("title"),
        squeeze("summary").alias("abstract"),
        F.filter(F.transform("author", lambda a: squeeze(a["name"])), lambda n: n != "").alias("authors"),
        F.transform("category", lambda c: c["_term"]).alias("categories"),
        F.col("primary_category._term").alias("primary_category"),
        F.col("published").alias("published_at"),
        F.col("updated").alias("updated_at"),
        F.substring("published", 1, 10).alias("submitted_date"),
        pick(lambda x: x["_rel"] == "alternate").alias("abs_url"),
        pick(lambda x: (x["_title"] == "pdf") | (x["_type"] == "application/pdf")).alias("pdf_url"),
        optional("doi"),
        optional("journal_ref"),
        optional("comment"),
    ]


def papers_of(entries: DataFrame) -> DataFrame:
    """Dataset rows of feed entries."""
    return entries.select(*_paper_columns())


def records_of(entries: DataFrame) -> DataFrame:
    """Store rows of feed entries: versions split, legacy ids whole, affiliations of authors that have any."""
    version = split_version("id")
    none = F.array().cast("array<string>")
    named = F.transform("author", lambda a: F.struct(squeeze(a["name"]).alias("k"), F.filter(F.coalesce(a["affiliation"], none), lambda x: F.trim(x) != "").alias("v")))
    own = F.filter(named, lambda a, i: (F.size(a["v"]) > 0) & ~F.exists(F.slice(named, F.lit(1), i), lambda b: (b["k"] == a["k"]) & (F.size(b["v"]) > 0)))
    more = {"version": version["version"], "_base": version["base"], "affiliations": F.map_from_entries(own)}
    wide = entries.withColumns(more)
    replaced = ("arxiv_id", "versioned_id", "submitted_date", "published_at", "updated_at")
    columns = {name: c for name, c in zip(papers_of(entries).columns, _paper_columns(), strict=True) if name not in replaced}
    return wide.select(
        F.col("_base").alias("arxiv_id"),
        F.concat("_base", F.lit("v"), F.col("version").cast("string")).alias("versioned_id"),
        "version",
        *(c.alias(name) for name, c in columns.items()),
        "affiliations",
        F.to_timestamp("published").alias("published_at"),
        F.to_timestamp("updated").alias("updated_at"),
    )


def demo(spark: SparkSession, seen: datetime = datetime(2026, 6, 3)) -> DataFrame:
    """Two made-up papers to try the library with: a batch for upsert() in the columns of the store."""
    rows = [
        ("9999.00001", "Robot grasping with a graph neural network", "Our method joins a graph neural network with a diffusion model. We report the success rate.", ["A. One", "B. Two"], ["cs.RO", "cs.LG"], datetime(2026, 6, 1)),
        ("9999.00002", "Transformers for image classification", "We show that contrastive learning improves accuracy on CIFAR-10 by 2%.", ["B. Two"], ["cs.CV", "cs.LG"], datetime(2026, 6, 2)),
    ]
    df = spark.createDataFrame(rows, "arxiv_id string, title string, abstract string, authors array<string>, categories array<string>, published_at timestamp")
    made = {
        "versioned_id": F.concat("arxiv_id", F.lit("v1")),
        "version": F.lit(1),
        "primary_category": F.get("categories", F.lit(0)),
        "updated_at": F.col("published_at"),
        "abs_url": F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id", F.lit("v1")),
        "position": F.lit(1).cast("long"),
        "seen_at": F.lit(seen),
    }
    df = df.withColumns(made)
    missing = [f for f in spark.createDataFrame([], PAPERS).schema if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
