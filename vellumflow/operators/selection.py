"""Bounding a paper's text for a prompt: sections first, else front and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions.text import head_tail

# Headings that count, and the heads of the parts of a prompt.
SECTION = r"(?imU)^\s*(?:\d+(?:\.\d+)*\s+)?(?:method|methodology|experiments|results|limitations|conclusion)s?\s*$"
FULL = "\nFULL PAPER TEXT\n"
SECTIONS = "\nPRIORITIZED PAPER SECTIONS\n"
SELECTED = "\nSELECTED FULL PAPER TEXT\n"
BREAK = "\n\n"


def sections(text: Column) -> Column:
    """Sections from each heading to the next one, trimmed."""
    heads = F.regexp_extract_all(text, F.lit(SECTION), F.lit(0))
    bodies = F.slice(F.split(text, SECTION, -1), F.lit(2), F.greatest(F.size(heads), F.lit(0)))
    return F.zip_with(heads, bodies, lambda h, b: F.regexp_replace(F.concat(h, b), r"(?U)^\s+|\s+$", ""))


def cut_sections(text: Column, budget: Column) -> Column:
    """All sections if they fit, else an equal share of each, the first ones one more; headings if not even breaks fit."""
    parts = sections(text)
    n = F.size(parts)
    whole = F.concat_ws(BREAK, parts)
    content = budget - len(BREAK) * (n - 1)
    share = F.floor(F.try_divide(content, n)).cast("int")
    cut = F.transform(parts, lambda p, i: F.substring(p, F.lit(1), share + F.when(i < content - share * n, 1).otherwise(0)))
    heads = F.concat_ws(BREAK, F.transform(parts, lambda p: F.get(F.split(p, r"\R", 2), F.lit(0))))
    return F.when(F.length(whole) <= budget, whole).when(content <= 0, F.substring(heads, F.lit(1), budget)).otherwise(F.concat_ws(BREAK, cut))


def prompt_text(papers: DataFrame, most: int = 70_000, title: str = "title", abstract: str = "abstract", text: str = "full_text", out: str = "prompt") -> DataFrame:
    """papers with a prompt of at most `most` characters that always holds title and abstract; too long ones are an error."""
    if most < 1:
        raise ValueError("the budget must be positive")
    header = F.concat(F.lit("TITLE\n"), F.col(title), F.lit("\n\nABSTRACT\n"), F.col(abstract), F.lit("\n"))
    df = papers.withColumn("_header", header).withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    body, left = F.col("_text"), F.lit(most) - F.length("_header")
    in_sections, in_part = left - len(SECTIONS), left - len(SELECTED)
    chosen = (
        F.when(body == "", F.lit(""))
        .when(F.length(body) + len(FULL) <= left, F.concat(F.lit(FULL), body))
        .when(body.rlike(SECTION), F.when(in_sections > 0, F.concat(F.lit(SECTIONS), cut_sections(body, in_sections))).otherwise(F.lit("")))
        .otherwise(F.when(in_part > 0, F.concat(F.lit(SELECTED), head_tail(body, in_part))).otherwise(F.lit("")))
    )
    too_long = F.raise_error(F.lit("the budget must hold title and abstract")).cast("string")
    return df.withColumn(out, F.when(F.length("_header") > most, too_long).otherwise(F.concat("_header", chosen))).drop("_header", "_text")
