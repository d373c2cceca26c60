"""Curating a dataset: quality order, proportional quotas, exclusions, daily counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumflow.functions.text import n_words, squeeze
from vellumflow.operators.ranks import ranked

# Prefixes of primary categories that are left out, and words that mark withdrawn papers.
EXCLUDED_PREFIXES = ("astro-ph.", "cond-mat.", "econ.")
WITHDRAWN = r"(?i)\b(withdrawn|retracted)\b"
MISSING = "(missing)"


def category_of(c: str = "primary_category") -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(MISSING))


def quality(title: str = "title", abstract: str = "abstract", key: str = "versioned_id") -> list[Column]:
    """Parts of the quality order, each better when larger: not withdrawn, length, metadata, form, and a hash for ties."""
    text = F.concat_ws(" ", title, abstract, "comment")
    filled = reduce(lambda a, b: a + b, [F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", 1).otherwise(0) for c in ("doi", "journal_ref", "comment")])
    form = F.when(n_words(F.coalesce(title, F.lit(""))).between(4, 30), 1).otherwise(0) + F.least(F.size(F.coalesce("categories", F.array().cast("array<string>"))), F.lit(3))
    return [(~squeeze(text).rlike(WITHDRAWN)).cast("int"), F.least(n_words(F.coalesce(abstract, F.lit(""))), F.lit(250)), filled, form, F.sha2(F.coalesce(key, F.lit("")), 256)]


def quotas(sizes: DataFrame, target: int, group: str = "category", size: str = "n") -> DataFrame:
    """group, n, quota: one each, the rest by largest remainders of size - 1; of equal remainders the larger name.

    sizes has a row for each group. A target of at least the total takes everything.
    """
    totals = sizes.agg(F.count(F.lit(1)).alias("groups"), F.sum(size).alias("total")).head()
    if not totals.groups:
        return sizes.withColumn("quota", F.lit(0).cast("long"))
    if target >= totals.total:
        return sizes.withColumn("quota", F.col(size).cast("long"))
    if target < totals.groups:
        raise ValueError("the target is smaller than the number of groups")
    left, population = target - totals.groups, totals.total - totals.groups
    share = F.lit(left) * (F.col(size) - 1) / F.lit(population)
    shared = sizes.withColumn("share", share.cast("double")).withColumn("whole", F.floor("share"))
    given = shared.agg(F.sum("whole")).head()[0]
    place = F.row_number().over(Window.orderBy((F.col("share") - F.col("whole")).desc(), F.col(group).desc()))
    return shared.withColumn("quota", 1 + F.col("whole") + F.when(place <= left - given, 1).otherwise(0)).drop("share", "whole")


def curate(papers: DataFrame, target: int, by: list[Column] | None = None, key: str = "versioned_id") -> DataFrame:
    """The best papers of each category within its quota; repeated rows of a kept key all stay.

    No task sorts a whole category: ranks come from ranges of category and order. Only key, category and order columns move.
    """
    named = papers.withColumn("_category", category_of())
    plan = quotas(named.groupBy(F.col("_category").alias("category")).agg(F.count(F.lit(1)).alias("n")), target)
    parts = list(by or quality())
    marks = [f"_o{i}" for i in range(len(parts))]
    rows = named.select(key, F.col("_category").alias("category"), *(c.alias(m) for c, m in zip(parts, marks, strict=True)))
    places = ranked(rows, "category", [F.col(m).desc() for m in marks], [key])
    # A row for each category.
    keep = places.join(F.broadcast(plan.select("category", "quota")), "category").where("place <= quota").select(key).distinct()
    return papers.join(keep, key, "left_semi")


def without_prefixes(papers: DataFrame, prefixes: tuple[str, ...] = EXCLUDED_PREFIXES, c: str = "primary_category") -> DataFrame:
    """Drops rows whose category starts with a prefix; null categories stay."""
    return papers.where(~reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")).startswith(p) for p in prefixes]))


def pulled(days: list[DataFrame]) -> DataFrame:
    """The rows of all pulls, as often as they were pulled."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), days)


def daily_counts(papers: DataFrame, first: str, last: str, day: str = "submitted_date") -> DataFrame:
    """date, paper_count for each day of the range, zero included; other days don't count."""
    spine = papers.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    counted = papers.groupBy(F.col(day).cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counted, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("paper_count"))
