"""Strict reading of JSON lines, with line numbers in errors, and writing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumflow.functions.text import valid_date
from vellumflow.schemas import CLASSIFIER_INPUT, VALIDITY_INPUT


#: Bits of monotonically_increasing_id that count within a partition.
PLACE_BITS = 33


class BadLine(ValueError):
    """A line that can't be read, with its number."""


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1) and value, in file order.

    Lines are numbered within their partition, and each partition starts after the counted lines of those before it: a
    first scan only counts.
    """
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    place, owner = F.expr(f"_at & {(1 << PLACE_BITS) - 1}L"), F.shiftright("_at", PLACE_BITS)
    counts = lines.groupBy(owner.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # One row for each partition of the file.
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return lines.withColumn("_p", owner).join(F.broadcast(before), "_p").select((F.col("_before") + place + 1).alias("line"), "value")


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """line, value, is_object, and the fields."""
    obj = F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    fields = [f.split()[0] for f in schema.split(", ")]
    df = lines.withColumn("_r", obj).withColumn("is_object", F.col("value").rlike(r"^\s*\{") & F.col("_r").isNotNull() & F.col("_r._broken").isNull())
    return df.select("line", "value", "is_object", *(F.col(f"_r.{f}").alias(f) for f in fields))


def check(rows: DataFrame, problems: list[tuple[Column, str]]) -> DataFrame:
    """rows with `problem`, the first that applies, or null."""
    said = reduce(lambda rest, p: F.when(p[0], F.lit(p[1])).otherwise(rest), reversed(problems), F.lit(None).cast("string"))
    return rows.withColumn("problem", said)


def raise_first(rows: DataFrame) -> None:
    """Raises the problem of the smallest line, found by one aggregate."""
    first = rows.where("problem is not null").agg(F.min("line").alias("line"), F.min_by("problem", "line").alias("problem")).head()
    if first.line is not None:
        raise BadLine(f"line {first.line}: {first.problem}")


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))


def _again(key: str) -> Column:
    # Lines without a key are no group: each is alone.
    alone = F.when(F.col(key).isNull(), F.col("line"))
    return F.row_number().over(Window.partitionBy(key, alone).orderBy("line")) > 1


def paper_problems(lines: DataFrame) -> DataFrame:
    """Lines (line, value) read as papers for claim extraction, with what is wrong with each, or null."""
    rows = parsed(lines, VALIDITY_INPUT)
    needed = ["arxiv_id", "versioned_id", "submitted_date", "title", "abstract"]
    problems = [(~F.col("is_object"), "not a JSON object"), *((_blank(c), f"{c} is missing") for c in needed)]
    problems += [(~valid_date("submitted_date"), "submitted_date is no date"), (_again("arxiv_id"), "arxiv_id is repeated")]
    return check(rows, problems)


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Papers for claim extraction: line and fields. The first line that is no object, lacks a field, has a bad date or repeats an id is an error; so is a blank line."""
    rows = paper_problems(numbered_lines(spark, path))
    raise_first(rows)
    return rows.drop("value", "is_object", "problem")


def example_problems(lines: DataFrame) -> DataFrame:
    """Lines (line, value) read as papers for classification, blank ones left out, with what is wrong with each, or null."""
    rows = parsed(lines.where(F.trim("value") != ""), CLASSIFIER_INPUT)
    rows = rows.withColumn("arxiv_id", F.coalesce(F.nullif(F.trim("arxiv_id"), F.lit("")), F.concat(F.lit("line-"), F.col("line").cast("string"))))
    rows = rows.withColumn("_first", F.min("line").over(Window.partitionBy("arxiv_id")))
    problems = [(~F.col("is_object"), "not a JSON object"), *((_blank(c), f"{c} is missing") for c in ("title", "abstract", "primary_category"))]
    rows = check(rows, problems)
    repeated = F.concat(F.lit("arxiv_id is repeated, first on line "), F.col("_first").cast("string"))
    return rows.withColumn("problem", F.coalesce("problem", F.when(F.col("line") > F.col("_first"), repeated))).drop("_first")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Papers for classification: blank lines are skipped, a missing id becomes line-N, a repeated one names its first line."""
    rows = example_problems(numbered_lines(spark, path))
    raise_first(rows)
    return rows.drop("value", "is_object", "problem")


def write_lines(rows: DataFrame, path: str, order: list[str]) -> None:
    """One object a line, keys sorted, nulls kept, in the given order."""
    rows.orderBy(*order).select(*sorted(rows.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_counts(counts: DataFrame, path: str) -> None:
    """date, paper_count with a header."""
    counts.orderBy("date").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
