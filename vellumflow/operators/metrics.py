"""Evaluation: sets, evidence, classes, calibration. Every figure is one aggregate over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The fields of a record that hold values.
VALUE_FIELDS = ["research_tasks", "methods", "datasets", "metrics", "domains", "contributions", "limitations"]


def ratio(a: Column, b: Column, otherwise: float) -> Column:
    """a / b, or the given value where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(otherwise))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r, 0.0)


def set_metrics(gold: DataFrame, predicted: DataFrame, on: list[str], by: list[str] | None = None) -> DataFrame:
    """true_positives, false_positives, false_negatives, precision, recall, f1 of predicted against gold, as sets.

    Empty denominators give 1. With by, a row for each group that either side has.
    """
    by = by or []
    keys = [*by, *on]
    a = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    b = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True).groupBy(*keys).agg(F.max("_g").alias("g"), F.max("_p").alias("p"))
    counts = both.groupBy(*by).agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("true_positives"),
        F.count_if(F.col("g").isNull()).alias("false_positives"),
        F.count_if(F.col("p").isNull()).alias("false_negatives"),
    )
    tp = F.col("true_positives")
    counts = counts.withColumns({"precision": ratio(tp, tp + F.col("false_positives"), 1.0), "recall": ratio(tp, tp + F.col("false_negatives"), 1.0)})
    return counts.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def evidence_coverage(features: Column) -> Column:
    """Share of a record's values (field and value without case) that evidence supports; 1 without values."""
    def pairs_of(f: str) -> Column:
        return F.transform(features[f], lambda v: F.concat(F.lit(f), F.lit("\0"), F.lower(v)))

    pairs = list(map(pairs_of, VALUE_FIELDS))
    values = F.array_distinct(F.concat(*pairs))
    backed = F.array_distinct(F.transform(features["evidence"], lambda e: F.concat(e["field"], F.lit("\0"), F.lower(e["value"]))))
    return ratio(F.size(F.array_intersect(values, backed)), F.size(values), 1.0)


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """label, n, weight: the root of the largest count over the count, over the mean of these."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    raw = F.sqrt(F.max("n").over(every) / F.col("n"))
    return counts.withColumn("_raw", raw).withColumn("weight", F.col("_raw") / F.avg("_raw").over(every)).drop("_raw")


def confusion(rows: DataFrame, truth: str, guess: str, top: int = 20) -> DataFrame:
    """The most frequent mistakes; equal counts go by names."""
    wrong = rows.where(F.col(truth) != F.col(guess)).groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    return wrong.orderBy(F.col("n").desc(), truth, guess).limit(top)


def class_report(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """label, support, precision, recall, f1 of every label in either column; 0 for empty denominators."""
    sides = rows.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(True).alias("t")), F.struct(F.col(guess).alias("label"), F.lit(False).alias("t")))).alias("x"), (F.col(truth) == F.col(guess)).alias("hit"))
    tally = sides.groupBy("x.label").agg(F.count_if("x.t").alias("support"), F.count_if(~F.col("x.t")).alias("guessed"), F.count_if(F.col("x.t") & F.col("hit")).alias("hits"))
    tally = tally.withColumns({"precision": ratio(F.col("hits"), F.col("guessed"), 0.0), "recall": ratio(F.col("hits"), F.col("support"), 0.0)})
    return tally.withColumn("f1", f1(F.col("precision"), F.col("recall"))).select("label", "support", "precision", "recall", "f1")


def summary(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: n, accuracy, macro_f1, weighted_f1, majority_baseline, uniform_baseline."""
    report = class_report(rows, truth, guess)
    scores = report.agg(
        F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support"), 0.0).alias("weighted_f1"),
        ratio(F.max("support"), F.sum("support"), 0.0).alias("majority_baseline"),
        ratio(F.lit(1), F.count_if(F.col("support") > 0), 0.0).alias("uniform_baseline"),
    )
    base = rows.agg(F.count(F.lit(1)).alias("n"), ratio(F.count_if(F.col(truth) == F.col(guess)), F.count(F.lit(1)), 0.0).alias("accuracy"))
    return base.join(scores)


def majority_label(train: DataFrame, label: str) -> DataFrame:
    """The most frequent label; of equals the smallest."""
    return train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), label).limit(1)


def ranked_labels(probabilities: Column, labels: list[str], k: int) -> Column:
    """The k most probable (label, probability), equal ones in label order."""
    pairs = F.transform(probabilities, lambda p, i: F.struct((-p).alias("o"), i.alias("i"), F.get(F.array(*map(F.lit, labels)), i).alias("label"), p.alias("probability")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda x: F.struct(x["label"].alias("label"), x["probability"].alias("probability")))


def top_k_accuracy(rows: DataFrame, truth: str, ranked: str, k: int = 3) -> DataFrame:
    hit = F.exists(F.slice(ranked, 1, k), lambda x: x["label"] == F.col(truth))
    return rows.agg(ratio(F.count_if(hit), F.count(F.lit(1)), 0.0).alias(f"top_{k}_accuracy"))


def calibration(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """A row for each bin (lower, upper] that has rows: lower, upper, n, accuracy, confidence. A confidence of 0 is in none."""
    edges = [i / bins for i in range(bins + 1)]
    bin_of = F.lit(None).cast("int")
    for i in range(bins - 1, -1, -1):
        bin_of = F.when((F.col(confidence) > edges[i]) & (F.col(confidence) <= edges[i + 1]), i).otherwise(bin_of)
    binned = rows.select(bin_of.alias("bin"), F.col(confidence).alias("c"), F.col(correct).cast("double").alias("ok")).where("bin is not null")
    out = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("ok").alias("accuracy"), F.avg("c").alias("confidence"))
    at = lambda i: F.get(F.array(*map(F.lit, edges)), i)
    return out.select(at(F.col("bin")).alias("lower"), at(F.col("bin") + 1).alias("upper"), "n", "accuracy", "confidence")


def calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    gap = calibration(rows, confidence, correct, bins).agg(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))).alias("gap"))
    return total.join(gap).select(F.coalesce(F.try_divide("gap", "total"), F.lit(0.0)).alias("calibration_error"))


def selective(rows: DataFrame, confidence: str, correct: str, thresholds: tuple[float, ...] = (0.5, 0.7, 0.9)) -> DataFrame:
    """threshold, kept, coverage, accuracy over rows at or above each threshold; nothing kept has accuracy 0."""
    sure = [(F.col(confidence) >= t) for t in thresholds]
    one = rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(s).alias(f"k{i}") for i, s in enumerate(sure)), *(F.count_if(s & F.col(correct)).alias(f"c{i}") for i, s in enumerate(sure)))
    lines = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"k{i}").alias("kept"), ratio(F.col(f"k{i}"), F.col("total"), 0.0).alias("coverage"), ratio(F.col(f"c{i}"), F.col(f"k{i}"), 0.0).alias("accuracy")) for i, t in enumerate(thresholds)))
    return one.select(F.inline(lines))


def worst_mistakes(rows: DataFrame, truth: str, guess: str, confidence: str, key: str, top: int = 25) -> DataFrame:
    """Wrong rows of the highest confidence."""
    return rows.where(F.col(truth) != F.col(guess)).orderBy(F.col(confidence).desc(), key).limit(top)
