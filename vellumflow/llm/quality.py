"""Quality rules with robust multivariate outlier rejection.

Per text statistics come from one vectorised pass. Within each language and source, a minimum-covariance-determinant
estimate gives centre and scatter of the transformed statistics; a row far from the centre by Mahalanobis distance is
rejected. Concentration steps over all rows go from two starts (medians with the spreads, and with the least spreads) until
the determinant of the core's scatter falls no more, and the least determinant met counts. The same is estimated for each
language and for all rows, and the fewer rows a group has, the more its model is drawn to that of the level above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.common import KEY, Scratch, arrow_map, join_small
from vellumflow.llm.kernel import SPACED, Lines, Texts, Words, code_points, mix, prefix, slices, span_hashes, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
REPEAT_WINDOW = 8
MIN_WORDS = 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_digits"]


def text_counts(column: pa.Array) -> list[np.ndarray]:
    """The COUNTS of each text."""
    texts = Texts(column)
    words = Words(texts, SPACED)
    n_words = np.diff(words.first)
    sums = lambda values, first: np.diff(np.concatenate([[0], np.cumsum(values)])[first])
    hashes = words.hashes()

    def groups(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order that brings equal hashes of one text together, and where in it each run of equals begins."""
        key = mix(h ^ mix(doc.astype(np.uint64)))
        order = np.argsort(key)
        head = np.ones(len(key), bool)
        head[1:] = key[order][1:] != key[order][:-1]
        return order, head

    at, grams = windows(words, prefix(hashes), REPEAT_WINDOW)
    order, head = groups(grams, words.doc[at])
    alone = head.copy()
    alone[:-1] &= head[1:]
    twice = at[order[~alone]]
    change = np.bincount(twice, minlength=len(words) + 1) - np.bincount(twice + REPEAT_WINDOW, minlength=len(words) + 1)
    covered = np.cumsum(change)[: len(words)] > 0
    order, head = groups(hashes, words.doc)
    distinct = np.bincount(words.doc[order[head]], minlength=texts.n)
    lines = Lines(texts)
    worded = np.flatnonzero(~lines.blank)
    line_hash = mix(span_hashes(texts.data, lines.start[worded], lines.end[worded]) + span_hashes(texts.data, lines.start[worded], lines.end[worded], second=True))
    order, head = groups(line_hash, lines.doc[worded])
    n_dup = np.bincount(lines.doc[worded], minlength=texts.n) - np.bincount(lines.doc[worded][order[head]], minlength=texts.n)
    spans = code_points(texts.data, words.start, words.end)
    data = texts.data
    return [
        n_words,
        sums(spans, words.first),
        sums(SYMBOLS[data], texts.offsets),
        np.diff(lines.first),
        n_dup,
        sums(covered, words.first),
        distinct,
        sums((data >= 65) & (data <= 90), texts.offsets),
        sums((data >= 48) & (data <= 57), texts.offsets),
    ]


#: Features are kept as integers of this scale, so that their sums are exact in any order.
SCALE = 4096
#: Least standard deviation of each feature.
FLOORS = {"length": 0.3, "word_size": 0.06, "symbols": 0.25, "variety": 0.03, "upper": 0.12, "digits": 0.4}
FEATURES = list(FLOORS)
#: Share of a group's rows that a concentration step keeps, and the factor that makes their scatter consistent for it with six features.
CORE, CONSISTENCY = 0.75, 1.36
#: A start ends when a step lowers the logarithm of the determinant by less.
LEAST_GAIN = 0.01
#: Squared distance beyond which a row goes: exceeded by one in 10^9 under a normal law with six features.
CUTOFF = 53.0
#: Groups with fewer rows share in the model of their language, and languages in that of all rows, the more the fewer they have.
LEAST_ROWS = 60
#: Squared distances are counted in steps of 1 / DISTANCE_STEPS.
DISTANCE_STEPS = 16
GROUP = ["lang", "source"]
#: Groups of level 0 are all rows, of level 1 a language, of level 2 a language and source.
LEVELED = ["level", *GROUP]
STARTED = [*LEVELED, "start"]


def _features(counts: list[np.ndarray]) -> list[np.ndarray]:
    c = dict(zip(COUNTS, counts, strict=True))
    n = np.maximum(c["n_words"], 1)
    values = [
        np.log(n),
        np.log(np.maximum(c["word_chars"], 1) / n),
        np.sqrt(c["n_symbols"] / n),
        np.log(np.maximum(c["n_distinct"], 1)) / np.log(n + 1),
        c["n_upper"] / n,
        np.sqrt(c["n_digits"] / n),
    ]
    return [np.round(v * SCALE).astype(np.int64) for v in values]


def _stats(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, "text"):
        counts = text_counts(part["text"])
        names = ["doc_id", *KEY, *GROUP]
        arrays = [pa.array(x.astype(np.int64)) for x in [*counts, *_features(counts)]]
        yield pa.RecordBatch.from_arrays([*(part[c] for c in names), *arrays], [*names, *COUNTS, *FEATURES])


def _moments() -> list:
    f = [F.col(x).cast("decimal(20,0)") for x in FEATURES]
    return [F.sum(x) for x in f] + [F.sum(f[i] * f[j]) for i in range(len(f)) for j in range(i, len(f))]


def _models(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Centre, scatter and inverse scatter of each group from its sums, and the logarithm of the determinant."""
    p = len(FEATURES)
    centres, scatters, inverses, logs = [], [], [], []
    for n, sums in zip(batch["n"].to_pylist(), batch["sums"].to_pylist(), strict=True):
        mean = [float(s) / n for s in sums[:p]]
        scatter = np.zeros((p, p))
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        for (i, j), s in zip(pairs, sums[p:], strict=True):
            scatter[i, j] = scatter[j, i] = float(s * n - sums[i] * sums[j]) / n / n
        scatter = CONSISTENCY * scatter + np.diag([(SCALE * x) ** 2 for x in FLOORS.values()])
        centres.append(mean)
        scatters.append(scatter.ravel().tolist())
        inverses.append(np.linalg.inv(scatter).ravel().tolist())
        logs.append(float(np.linalg.slogdet(scatter)[1]))
    arrays = [*(pa.array(x, pa.list_(pa.float64())) for x in (centres, scatters, inverses)), pa.array(logs)]
    yield pa.record_batch([*(batch[c] for c in STARTED), *arrays], [*STARTED, "centre", "scatter", "inverse", "log_det"])


MODELS = "level int, lang string, source string, start int, centre array<double>, scatter array<double>, inverse array<double>, log_det double"


def _blend(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Centre and inverse scatter of each language and source, drawn to the levels above by the rows that are short of LEAST_ROWS.

    Above all rows is nothing to be drawn to: fewer than LEAST_ROWS rows in all widen their scatter in proportion.
    """
    p = len(FEATURES)
    centres, inverses = [], []
    for row in batch.to_pylist():
        centre, scatter = None, None
        for level in range(3):
            share = min(1.0, row[f"rows_{level}"] / LEAST_ROWS)
            own, spread = np.array(row[f"centre_{level}"]), np.array(row[f"scatter_{level}"])
            if level == 0:
                centre, scatter = own, spread / share
            else:
                centre, scatter = share * own + (1 - share) * centre, share * spread + (1 - share) * scatter
        centres.append(centre.tolist())
        inverses.append(np.linalg.inv(scatter.reshape(p, p)).ravel().tolist())
    yield pa.record_batch([batch["lang"], batch["source"], pa.array(centres, pa.list_(pa.float64())), pa.array(inverses, pa.list_(pa.float64()))], [*GROUP, "centre", "inverse"])


def _distance():
    p = len(FEATURES)
    away = [F.col(x) - F.col("centre")[i] for i, x in enumerate(FEATURES)]
    terms = [away[i] * away[j] * F.col("inverse")[i * p + j] * (1 if i == j else 2) for i in range(p) for j in range(i, p)]
    return sum(terms[1:], terms[0])


def _leveled(stats: DataFrame) -> DataFrame:
    """Each row once for each level."""
    none = F.lit("")
    kinds = [(none, none), (F.col("lang"), none), (F.col("lang"), F.col("source"))]
    levels = F.array(*(F.struct(F.lit(i).alias("level"), a.alias("lang"), b.alias("source")) for i, (a, b) in enumerate(kinds)))
    return stats.select(F.explode(levels).alias("_level"), *FEATURES).select("_level.*", *FEATURES)


def robust_models(stats: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, source, centre, inverse for each language and source of stats (stored).

    Every step aggregates over all rows of the groups that it still changes, combined before the shuffle; only a row for
    each group and start comes out. A step that counts lowers a determinant that the least spreads bound from below, so
    the steps end.
    """
    stats = _leveled(stats)
    middle = scratch.store(stats.groupBy(*LEVELED).agg(F.count(F.lit(1)).alias("rows"), *(F.percentile(x, 0.5).alias(f"m_{x}") for x in FEATURES)), "middle")
    spread = _with(stats, middle).groupBy(*LEVELED).agg(*(F.percentile(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5).alias(f"s_{x}") for x in FEATURES))
    p = len(FEATURES)
    floors = [F.lit((SCALE * FLOORS[x]) ** 2) for x in FEATURES]
    wide = [F.pow(1.4826 * F.col(f"s_{x}"), F.lit(2)) + floor for x, floor in zip(FEATURES, floors, strict=True)]
    inverse = lambda variance: F.array(*(F.lit(1.0) / variance[i] if i == j else F.lit(0.0) for i in range(p) for j in range(p)))
    starts = F.explode(F.array(*(F.struct(F.lit(i).alias("start"), inverse(v).alias("inverse")) for i, v in enumerate((wide, floors)))))
    centre = F.array(*(F.col(f"m_{x}") for x in FEATURES))
    first = spread.join(middle, LEVELED).select(*LEVELED, centre.alias("centre"), starts.alias("s"))
    moving = scratch.store(first.select(*LEVELED, "s.start", "centre", "s.inverse", F.lit(float("inf")).alias("log_det")), "models/0")
    step = 0
    while moving.limit(1).count():
        step += 1
        placed = _with(stats, moving.select(*STARTED, "centre", "inverse"))
        placed = placed.select(*STARTED, *FEATURES, F.least(F.floor(_distance() * DISTANCE_STEPS), F.lit(1 << 14)).cast("int").alias("d"))
        radius = scratch.store(placed.groupBy(*STARTED).agg(F.percentile("d", CORE).alias("radius")), f"radius_{step}")
        core = join_small(placed, radius, STARTED, "inner", 100).where("d <= radius")
        sums = core.groupBy(*STARTED).agg(F.count(F.lit(1)).alias("n"), F.array(*_moments()).alias("sums"))
        models = scratch.store(arrow_map(sums, _models, MODELS), f"models/{step}")
        moving = models.join(moving.select(*STARTED, F.col("log_det").alias("before")), STARTED).where(F.col("log_det") < F.col("before") - LEAST_GAIN)
        moving = scratch.store(moving.drop("before", "scatter"), f"moving_{step}")
    if not step:
        return scratch.store(scratch.spark.createDataFrame([], "lang string, source string, centre array<double>, inverse array<double>"), "models_of_groups")
    every = scratch.spark.read.schema(MODELS).parquet(*(f"{scratch.path}/models/{i}" for i in range(1, step + 1)))
    least = every.groupBy(*LEVELED).agg(F.min_by(F.struct("centre", "scatter"), F.struct("log_det", "start", "centre")).alias("m"))
    counted = scratch.store(least.select(*LEVELED, "m.*").join(middle.select(*LEVELED, "rows"), LEVELED), "counted")
    above = lambda i: counted.where(F.col("level") == i).select(*GROUP[:i], *(F.col(c).alias(f"{c}_{i}") for c in ("rows", "centre", "scatter")))
    levels = join_small(above(2), above(1), ["lang"], "inner", 600).crossJoin(F.broadcast(above(0)))
    blended = arrow_map(levels, _blend, "lang string, source string, centre array<double>, inverse array<double>")
    return scratch.store(blended, "models_of_groups")


def _with(stats: DataFrame, models: DataFrame) -> DataFrame:
    return join_small(stats, models, LEVELED, "inner", 600)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Base rules, and the verdict of the robust models of each language and source.

    Returns a row for each row of docs: doc_id, the row key _d, _t, the COUNTS, base_failed, distance (squared; null
    where the base rules fail) and kept. A row is kept if it passes the base rules and isn't beyond CUTOFF.

    Null, empty or blank texts have no words and fail the base rules. Null language or source counts as the empty
    string. Groups under LEAST_ROWS passing rows are judged too, with a share of the model of their language. Rows are
    judged one by one; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    labels = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    rows = labels.select("*", F.xxhash64("doc_id").alias("_d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"{c} long" for c in [*COUNTS, *FEATURES])
    stats = arrow_map(rows, _stats, f"doc_id {kind}, _d long, _t long, lang string, source string, {fields}")
    stats = scratch.store(stats.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 30 * n_words")), "stats")
    models = robust_models(stats.where("not base_failed"), scratch)
    out = join_small(stats, models, GROUP, "left", 600)
    out = out.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return out.select("doc_id", *KEY, *COUNTS, "base_failed", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).alias("kept"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
