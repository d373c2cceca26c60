"""Examples for a classifier: rare classes out, and a stratified split by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hexadecimal digits of the hash that name a range: 4,096 ranges for each class.
RANGE_DIGITS = 3


def without_rare(rows: DataFrame, label: str, least: int = 5) -> DataFrame:
    """Rows of labels with at least `least` rows (3 or more, so that each split has one)."""
    if least < 3:
        raise ValueError("at least three rows of each class are needed")
    frequent = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(label)
    return rows.join(frequent, label, "left_semi")


def split_sizes(sizes: DataFrame, label: str, validation: float = 0.15, test: float = 0.15) -> DataFrame:
    """label, n, test, validation, train: halves round to even, each at least 1, reduced until train has one.

    Test is reduced first where it is at least as large as validation.
    """
    for x in (validation, test):
        if not 0 < x < 1:
            raise ValueError("fractions lie between 0 and 1")
    part = lambda share: F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(share)).cast("long"))
    state = F.struct(part(test).alias("t"), part(validation).alias("v"))

    def less(acc, _):
        from_test = (acc["t"] >= acc["v"]) & (acc["t"] > 1)
        smaller = F.struct((acc["t"] - from_test.cast("long")).alias("t"), (acc["v"] - (~from_test).cast("long")).alias("v"))
        return F.when(F.col("n") - acc["t"] - acc["v"] < 1, smaller).otherwise(acc)

    few = sizes.where("n < 3").limit(1).count()
    if few:
        raise ValueError("every class needs three rows or more")
    excess = F.greatest(F.lit(0).cast("long"), 1 - (F.col("n") - part(test) - part(validation)))
    cut = F.aggregate(F.when(excess > 0, F.sequence(F.lit(1).cast("long"), excess)).otherwise(F.array().cast("array<long>")), state, less)
    return sizes.withColumn("_s", cut).select(label, "n", F.col("_s.t").alias("test"), F.col("_s.v").alias("validation"), (F.col("n") - F.col("_s.t") - F.col("_s.v")).alias("train"))


def _order(key: str, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def _range(order: str) -> Column:
    return F.substring(order, 1, RANGE_DIGITS)


def _before(dealt: DataFrame, label: str) -> DataFrame:
    """_l, _r, _n, _before: of each range of a class, how many rows it has and how many are in earlier ones."""
    counts = dealt.groupBy(label, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(F.col(label).alias("_l"), F.col("_range").alias("_r"), "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))


def borders(keys: DataFrame, key: str, label: str, validation: float = 0.15, test: float = 0.15, seed: int = 42) -> tuple[dict, int] | None:
    """For each class the last row of test and of validation, each as (hash, key), and the number of training rows; None if keys that are equal or null lie at a border.

    Only ranges that a border is in are ordered. The result has a row for each class.
    """
    dealt = keys.select(label, F.col(key).alias("_key"), _order(key, seed).alias("_order")).withColumn("_range", _range("_order")).persist()
    try:
        sizes = split_sizes(dealt.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label, validation, test).persist()
        ends = F.array(F.col("test"), F.col("test") + F.col("validation"))
        ranges = _before(dealt, label).join(F.broadcast(sizes), F.col("_l") == F.col(label)).select("_l", "_r", "_before", "_n", ends.alias("_ends"))
        few = ranges.where(F.exists("_ends", lambda e: (F.col("_before") < e) & (e <= F.col("_before") + F.col("_n"))))
        near = dealt.join(F.broadcast(few), (F.col(label) == F.col("_l")) & (F.col("_range").eqNullSafe(F.col("_r"))))
        place = F.col("_before") + F.row_number().over(Window.partitionBy(label, "_range").orderBy("_order", "_key"))
        placed = near.withColumn("_place", place).where(F.exists("_ends", lambda e: (F.col("_place") == e) | (F.col("_place") == e + 1)))
        rows = {(r[label], r["_place"]): (r["_order"], r["_key"]) for r in placed.select(label, "_place", "_order", "_key").collect()}
        out, n = {}, 0
        for s in sizes.where(F.col(label).isNotNull()).collect():
            last = [(rows[s[label], e], rows.get((s[label], e + 1))) for e in (s["test"], s["test"] + s["validation"])]
            if any(a[0] is None or a == b for a, b in last):
                return None
            out[s[label]], n = [a for a, _ in last], n + s["train"]
        sizes.unpersist()
        return out, n
    finally:
        dealt.unpersist()


def within(rows: DataFrame, key: str, label: str, ends: dict, seed: int = 42) -> DataFrame:
    """rows of the classes of borders() with split, each row by itself: texts are not shuffled."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"_l {kind[label]}, _to string, _tk {kind[key]}, _vo string, _vk {kind[key]}"
    table = rows.sparkSession.createDataFrame([(name, *t, *v) for name, (t, v) in ends.items()], schema)
    upto = lambda o, k: (F.col("_order") < F.col(o)) | ((F.col("_order") == F.col(o)) & (F.col(key) <= F.col(k)))
    name = F.when(upto("_to", "_tk"), "test").when(upto("_vo", "_vk"), "validation").otherwise("train")
    return rows.withColumn("_order", _order(key, seed)).join(F.broadcast(table), F.col(label) == F.col("_l")).select(*rows.columns, name.alias("split"))


def stratified(rows: DataFrame, key: str, label: str, validation: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """rows with split: test, validation or train, by the order of a seeded hash of the key within each class."""
    sizes = split_sizes(rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label, validation, test)
    # Hashes are spread evenly: ranges of their first digits deal a class of any size over tasks.
    dealt = rows.withColumn("_order", _order(key, seed)).withColumn("_range", _range("_order"))
    before = _before(dealt, label).drop("_n")
    own = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_order", key))
    placed = dealt.withColumn("_own", own).join(before, (F.col(label) == F.col("_l")) & (F.col("_range") == F.col("_r")))
    placed = placed.withColumn("_place", F.col("_before") + F.col("_own"))
    joined = placed.join(sizes.select(label, "test", "validation"), label)
    name = F.when(F.col("_place") <= F.col("test"), "test").when(F.col("_place") <= F.col("test") + F.col("validation"), "validation").otherwise("train")
    return joined.select(*rows.columns, name.alias("split"))
