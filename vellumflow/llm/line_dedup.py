"""Line dedup over levelled sorted runs of line hashes.

A run is a stored table of line keys (two 64-bit hashes), in buckets of the key and sorted in each, with the number of
documents that hold the key. The first run that sees a key also names its keeper. A new batch of lines is sorted
once and merge-joined with the runs, which are read in their order: keys that no run has are new and get the batch's
largest document as keeper, the others only add to counts. FANOUT runs of a level are compacted into one run of the
next. Batches come in descending document order, so the keeper of a key is the largest document that holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.common import KEY, Scratch, arrow_map, buckets, join_keyed, join_small, keyed
from vellumflow.llm.kernel import LOWER, Lines, Texts, as_signed, code_points, mix, slices, span_hashes

LINE = ["k1", "k2"]
FANOUT = 2
LEAST_ID = -(1 << 63)


class LineRuns:
    """The runs of one index, by level."""

    def __init__(self, scratch: Scratch, fanout: int = FANOUT):
        self.scratch, self.fanout = scratch, fanout
        self.levels: list[dict[str, DataFrame]] = [{}]
        self.made = 0

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level.values()]

    def _write(self, df: DataFrame, dealt: bool) -> tuple[str, DataFrame]:
        name = f"run{self.made}"
        self.made += 1
        return name, self.scratch.store_sorted(df, name, LINE, dealt)

    def _merge(self, runs: dict[str, DataFrame]) -> tuple[str, DataFrame]:
        """One run of several, two by two, the later (smaller) ones first; the old ones go."""
        rest = list(runs.items())
        while len(rest) > 1:
            (a, one), (b, two) = rest.pop(), rest.pop()
            rest.append(self._write(_merged(one, two), True))
            self.scratch.drop(a)
            self.scratch.drop(b)
        return rest[0]

    def add(self, batch: DataFrame) -> None:
        """batch: k1, k2, n (documents), keeper (the largest); a row for each key."""
        runs = self.runs()
        if runs:
            batch = batch.repartition(buckets(batch.sparkSession), *LINE)
            for i, run in enumerate(runs):
                batch = batch.join(run.select(*LINE, F.col("keeper").isNotNull().alias(f"_seen{i}")).hint("merge"), LINE, "left")
            old = reduce(lambda a, b: a | b, (F.coalesce(f"_seen{i}", F.lit(False)) for i in range(len(runs))))
            batch = batch.select(*LINE, "n", F.when(~old, F.col("keeper")).alias("keeper"))
        name, run = self._write(batch, bool(runs))
        self.levels[0][name] = run
        for level, own in enumerate(self.levels):
            if len(own) < self.fanout:
                break
            if level + 1 == len(self.levels):
                self.levels.append({})
            name, run = self._merge(own)
            self.levels[level + 1][name] = run
            self.levels[level] = {}

    def totals(self) -> DataFrame:
        """k1, k2, n, keeper of every key, once a batch was added: all runs in one."""
        runs = {name: run for level in reversed(self.levels) for name, run in level.items()}
        name, run = self._merge(runs)
        self.levels = [{name: run}]
        return run


def _merged(one: DataFrame, two: DataFrame) -> DataFrame:
    one = one.withColumnsRenamed({"n": "n1", "keeper": "keeper1"})
    both = one.join(two.hint("merge"), LINE, "full")
    return both.select(*LINE, (F.coalesce("n1", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"), F.greatest("keeper1", "keeper").alias("keeper"))


def _keys(lines: Lines, texts: Texts, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[texts.data]
    low, high = lines.low[rows], lines.high[rows]
    return span_hashes(data, low, high), span_hashes(data, low, high, second=True)


def _long_lines(lines: Lines, texts: Texts, least: int) -> np.ndarray:
    return np.flatnonzero(~lines.blank & (code_points(texts.data, lines.low, lines.high) >= least)) if least > 0 else np.arange(len(lines.start))


def _emit_keys(batch: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    """Each key once for each row."""
    for part in slices(batch, "text"):
        texts = Texts(part["text"])
        lines = Lines(texts)
        rows = _long_lines(lines, texts, least)
        k1, k2 = _keys(lines, texts, rows)
        doc = lines.doc[rows]
        order = np.lexsort((k2, k1, doc))
        k1, k2, doc = k1[order], k2[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        k1, k2, at = k1[new], k2[new], pa.array(doc[new])
        yield pa.record_batch([pa.array(as_signed(k1)), pa.array(as_signed(k2)), *(part[c].take(at) for c in ("id", *KEY))], [*LINE, "id", *KEY])


def _drop_lines(batch: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, "text"):
        texts = Texts(part["text"])
        lines = Lines(texts)
        rows = _long_lines(lines, texts, least)
        k1, k2 = _keys(lines, texts, rows)
        tag = lambda doc, a, b: mix(mix(a + doc.astype(np.uint64)) + b)
        counts = np.diff(np.asarray(part["drop1"].offsets))
        doc_of = np.repeat(np.arange(part.num_rows), counts)
        listed = [np.asarray(part[c].flatten()).astype(np.int64).view(np.uint64) for c in ("drop1", "drop2")]
        gone = np.zeros(len(lines.start), bool)
        gone[rows] = np.isin(tag(lines.doc[rows], k1, k2), tag(doc_of, *listed))
        kept = np.flatnonzero(~gone)
        first = np.searchsorted(kept, lines.first)
        data = texts.data.tobytes()
        out = []
        for i in range(part.num_rows):
            own = kept[first[i] : first[i + 1]]
            out.append(b"\n".join([data[a:b] for a, b in zip(lines.start[own].tolist(), lines.end[own].tolist(), strict=True)]))
        n_lines = np.diff(lines.first)
        yield pa.record_batch(
            [
                part["doc_id"],
                part["_d"],
                part["_t"],
                pa.array(n_lines.astype(np.int64)),
                pa.array((n_lines - np.diff(first)).astype(np.int64)),
                pa.array([hashlib.sha256(x).hexdigest() for x in out]),
                pa.array([x.decode("utf-8", "replace") for x in out], pa.string()),
            ],
            ["doc_id", *KEY, "n_lines", "n_dropped", "kept_sha256", "kept_text"],
        )


def drop_common_lines(
    docs: DataFrame,
    min_docs: int = 5,
    min_chars: int = 40,
    batches: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = True,
    carry: list[str] | None = None,
) -> DataFrame:
    """Drops lines whose key stands in at least min_docs documents, except in the largest document id holding it.

    A key is the line without outer ASCII white space, A-Z lower-cased; keys under min_chars code points stay.
    Returns a row for each row of docs: doc_id, n_lines, n_dropped, kept_sha256, kept_text, and the row key _d, _t
    (with_text=False: the first four), or with `carry` a row for each row of docs with the columns named there,
    and after them n_lines, n_dropped and kept_text.

    Null or empty text is one empty line. Each row is a document; rows with one id all keep a line that their
    id keeps. A null id counts as the smallest. An empty table gives an empty table. Columns that aren't carried are
    ignored, whatever their names; ids are integers.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = keyed(docs, id_col, text_col)
    if carry:
        rows = docs.select(F.struct(*carry).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("_id"))
        rows = rows.select("*", F.xxhash64("_id").alias("_d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"))
    named = rows.select(F.coalesce(F.col("_id" if carry else "doc_id").cast("long"), F.lit(LEAST_ID)).alias("id"), "text", *KEY)
    keys = scratch.store(arrow_map(named, lambda b: _emit_keys(b, min_chars), "k1 long, k2 long, id long, _d long, _t long"), "keys")
    parts = [i / batches for i in range(1, batches)]
    bounds = sorted(set(keys.agg(F.percentile_approx("id", parts).alias("q")).head().q or [])) if parts else []
    batch_of = F.lit(0)
    for i, bound in enumerate(bounds):
        batch_of = F.when(F.col("id") > F.lit(bound), i + 1).otherwise(batch_of)
    incoming = keys.groupBy(batch_of.alias("batch"), *LINE).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
    incoming = scratch.store(incoming, "incoming", partition_by="batch")
    runs = LineRuns(scratch)
    for i in range(len(bounds), -1, -1):
        runs.add(incoming.where(F.col("batch") == i).drop("batch"))
    common = scratch.store(runs.totals().where(F.col("n") >= min_docs).drop("n"), "common")
    for name in ("incoming", *(x for level in runs.levels for x in level)):
        scratch.drop(name)
    held = join_small(keys, common, LINE, "inner", 64).where("id <> keeper")
    held = held.select(*KEY, *LINE).distinct().groupBy(*KEY).agg(F.collect_list(F.struct(*LINE)).alias("drops"))
    held = scratch.store(held, "held")
    scratch.drop("keys")
    empty = F.expr("array()").cast("array<long>")
    joined = join_keyed(rows, held, KEY, "left").select("doc_id", "text", *KEY, F.coalesce("drops.k1", empty).alias("drop1"), F.coalesce("drops.k2", empty).alias("drop2"))
    kind = joined.schema["doc_id"].dataType.simpleString()
    out = arrow_map(joined, lambda b: _drop_lines(b, min_chars), f"doc_id {kind}, _d long, _t long, n_lines long, n_dropped long, kept_sha256 string, kept_text string")
    if carry:
        return out.select("doc_id.*", "n_lines", "n_dropped", "kept_text")
    return out if with_text else out.drop("kept_text", *KEY)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_common_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
