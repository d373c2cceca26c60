"""The corpus pipeline: quality rules, line dedup, near dedup, secret masking and packing, one stage after the other.

Every stage reads what its predecessor kept. All but the last return the columns of documents: doc_id, text, lang, source
and n_chars; other columns, whatever their names, are left behind. An empty table gives an empty table. No stage can be written in SQL as a whole (robust models, Markov models, packing), so ORACLE_SQL is None
and the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.llm.common import KEY, Scratch, join_small, passing
from vellumflow.llm.line_dedup import drop_common_lines
from vellumflow.llm.near_dedup import near_duplicates
from vellumflow.llm.packing import pack_documents
from vellumflow.llm.quality import judge
from vellumflow.llm.secret_scan import find_secrets, masked

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and the row key of the operators."""
    return docs.select(*COLUMNS, F.xxhash64("doc_id").alias("_d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs less the rows whose key is rejected."""
    rejected = Scratch(docs.sparkSession).store(rejected.select(*KEY).distinct(), "rejected")
    return join_small(_keyed(docs), rejected, KEY, "left_anti", 64).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far outside their language and source go.

    Null, empty and blank texts have no words and go. A null language or source is a group like others. Rows with one id are
    judged each for itself; equal rows go or stay together.
    """
    return _without(docs, judge(docs).where("not kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters that stand in five documents or more stay in the largest document only.

    Every document stays, also with a null or empty text; a null text stays null. Rows of one id all keep a line that their id
    keeps.
    """
    out = drop_common_lines(docs, carry=COLUMNS)
    out = out.withColumn("text", F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the smallest document stays.

    Rows that repeat an id and a text stay together. Null and empty texts have no shingles and stay, each its own component,
    as do rows without id, unless a row with one is in their component.
    """
    return _without(docs, near_duplicates(docs).where("not kept"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays, and so does a null text."""
    named = docs.select(F.struct("doc_id", "lang", "source", F.col("text").isNull().alias("none")).alias("row"), "text")
    found = find_secrets(named, id_col="row")
    text = F.when(~F.col("doc_id.none"), masked("text", "spans"))
    out = found.select("doc_id.doc_id", text.alias("text"), "doc_id.lang", "doc_id.source")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences. A null or empty text is one piece of one token; equal rows are packed each for itself."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet in the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for name, stage in STAGES[:-1]:
        with passing():
            docs = scratch.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
