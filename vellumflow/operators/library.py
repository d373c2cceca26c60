"""Reads over the paper store: pages, look-ups, work lists and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.functions.unicode import casefolded

NEWEST = 500
# The fields that a page lists.
SHOWN = ["arxiv_id", "versioned_id", "version", "title", "abstract", "authors", "primary_category", "categories", "published_at", "updated_at", "abs_url", "pdf_url", "doi", "journal_ref", "comment"]


def clamp_limit(value: object, most: int = NEWEST) -> int:
    """A page size between 1 and `most`; what isn't an integer is an error."""
    if isinstance(value, bool):
        raise ValueError("limit must be an integer")
    try:
        return max(1, min(most, int(str(value).strip())))
    except ValueError:
        raise ValueError("limit must be an integer") from None


def newest(papers: DataFrame, n: int | None = None, by: str = "published_at", key: str = "arxiv_id") -> DataFrame:
    """Newest first; equal times go by key."""
    ordered = papers.orderBy(F.col(by).desc(), F.col(key))
    return ordered if n is None else ordered.limit(n)


def search(papers: DataFrame, needle: str = "", category: str = "", limit: int = 100, first: int = NEWEST, by: str = "published_at", key: str = "arxiv_id") -> DataFrame:
    """A page: of the `first` newest papers those of a category that hold the needle, the newest `limit` of them.

    The first limit comes before the filters on purpose; the filters don't pass it.
    """
    page = newest(papers, first, by, key)
    if category:
        page = page.where(F.array_contains("categories", category))
    if needle.strip():
        text = casefolded(F.concat_ws(" ", "title", "abstract", key, F.concat_ws(" ", "authors")))
        page = page.where(text.contains(needle.strip().casefold()))
    return page.orderBy(F.col(by).desc(), F.col(key)).limit(clamp_limit(limit))


def shown(papers: DataFrame) -> DataFrame:
    """What a page lists, times as ISO text."""
    iso = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx") for c in ("published_at", "updated_at")}
    return papers.select(*(iso[c].alias(c) if c in iso else c for c in SHOWN))


def lookup(papers: DataFrame, arxiv_id: str) -> DataFrame:
    return papers.where(F.col("arxiv_id") == arxiv_id).limit(1)


def file_paths(papers: DataFrame, arxiv_id: str) -> tuple[str | None, str | None]:
    row = lookup(papers, arxiv_id).select("pdf_path", "text_path").head()
    if row is None:
        raise KeyError(arxiv_id)
    return row.pdf_path, row.text_path


def stale(source: str, extractor: str, version: str, prompt: str | None):
    """Has a paper no features of its current version by this extractor."""
    differs = (F.col("source_versioned_id") != F.col(source)) | (F.col("extractor") != extractor) | (F.col("extractor_version") != version)
    return F.col("source_versioned_id").isNull() | differs | (F.coalesce("prompt_version", F.lit("")) != (prompt or ""))


def work_list(papers: DataFrame, features: DataFrame, extractor: str, version: str, prompt: str | None = None, limit: int = 100) -> DataFrame:
    """Papers to extract again, oldest first."""
    joined = papers.join(features.drop("features"), "arxiv_id", "left").where(stale("versioned_id", extractor, version, prompt))
    return joined.orderBy("published_at", "arxiv_id").limit(limit).select(*papers.columns)


def current_features(papers: DataFrame, features: DataFrame, limit: int | None = None) -> DataFrame:
    """Features that describe the stored version of their paper, oldest paper first."""
    joined = features.join(papers.select("arxiv_id", "versioned_id", "published_at"), "arxiv_id").where("versioned_id = source_versioned_id")
    ordered = joined.orderBy("published_at", "arxiv_id")
    return ordered if limit is None else ordered.limit(limit)


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is missing; none in a sound store."""
    return children.join(parents.select(key), key, "left_anti")


def differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key and difference (left only, right only, different) of rows that two tables of one schema, each with unique keys, don't share."""
    pack = lambda df, name: df.select(key, F.struct(*sorted(left.columns)).alias(name))
    both = pack(left, "_l").join(pack(right, "_r"), key, "full")
    side = F.when(F.col("_r").isNull(), "left only").when(F.col("_l").isNull(), "right only").when(~F.col("_l").eqNullSafe(F.col("_r")), "different")
    return both.select(key, side.alias("difference")).where("difference is not null")


def store_counts(**tables: DataFrame) -> DataFrame:
    """One row with the row count of each table, in one job."""
    each = [df.select(F.lit(name).alias("name"), F.lit(1).alias("one")) for name, df in tables.items()]
    rows = reduce(DataFrame.unionAll, each)
    return rows.agg(*(F.count_if(F.col("name") == name).alias(name) for name in tables))


def categories(papers: DataFrame) -> DataFrame:
    return papers.select(F.explode("categories").alias("category")).distinct().orderBy("category")
