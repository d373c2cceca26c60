"""Case folding as an expression against Python's."""

from pyspark.sql import functions as F

from vellumflow.functions.unicode import casefolded


def test_all_code_points(spark):
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    # Runs, so that letters that become several stand among others, and each of them alone.
    texts = ["".join(every[i : i + 1000]) for i in range(0, len(every), 1000)]
    texts += [c for c in every if len(c.casefold()) > 1] + ["", "Straße", "ŒUVRE İ"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = {r.i: r.f for r in df.select("i", casefolded("s").alias("f")).collect()}
    assert all(got[i] == t.casefold() for i, t in enumerate(texts))
    assert spark.range(1).select(casefolded(F.lit(None).cast("string")).alias("f")).collect()[0].f is None
