"""Substring dedup: seeds are winnowed anchors, joined across documents and extended both ways to maximal repeats.

A window is `length` consecutive words. Winnowing picks in each window its smallest k-gram hash (the leftmost of
equals), so equal windows pick the same anchor at the same place. An occurrence of an anchor owns the windows that
picked it; their joint span is its context, that is, the seed extended both ways as far as a repeat over the
length threshold can reach. Anchors that occur once end there. Occurrences with equal contexts repeat as a whole;
of anchors with several contexts, each distinct context is compared window by window. Nothing is emitted per pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumflow.llm.common import KEY, Scratch, arrow_map, join_keyed, keyed
from vellumflow.llm.kernel import SPACED, Texts, Words, as_signed, mix, powers, prefix, range_hash, slices, windows

#: Anchors with more distinct contexts than this are counted by window hash over all tasks, others by anchor.
HOT_CONTEXTS = 4096


def _leftmost_min(h: np.ndarray, width: int) -> np.ndarray:
    """For each i, the index of the smallest of h[i : i + width], the leftmost of equals."""
    at, size = np.arange(len(h)), 1
    while size < width:
        step = min(size, width - size)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(h[a] <= h[b], a, b)
        size += step
    return at


class _Anchors:
    """The anchors of some texts: position (word index), first owned window and number of owned windows of each."""

    def __init__(self, texts: Texts, length: int, k: int):
        self.words = Words(texts, SPACED)
        self.total = prefix(self.words.hashes())
        starts, hashes = windows(self.words, self.total, length)
        self.starts, self.hashes = starts, hashes
        if len(starts):
            i = np.arange(len(self.words) - k + 1)
            grams = range_hash(self.total, i, i + k)
            picked = _leftmost_min(grams, length - k + 1)[starts]
            self.position, self.row, self.owned = np.unique(picked, return_index=True, return_counts=True)
            self.seed = grams[self.position]
            low = starts[self.row]
            span = range_hash(self.total, low, low + self.owned + length - 1)
            self.context = mix(span + (self.position - low).astype(np.uint64) + powers(31, 128)[0][self.owned])
        else:
            self.position = self.row = self.owned = np.zeros(0, np.int64)
            self.seed = self.context = np.zeros(0, np.uint64)


def _emit_anchors(batch: pa.RecordBatch, length: int, k: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, "text"):
        found = _Anchors(Texts(part["text"]), length, k)
        if len(found.position):
            doc = found.words.doc[found.position]
            low = found.starts[found.row] - found.words.first[doc]
            yield pa.record_batch(
                [
                    pa.array(as_signed(found.seed)),
                    pa.array(as_signed(found.context)),
                    part["_d"].take(pa.array(doc)),
                    part["_t"].take(pa.array(doc)),
                    pa.array(low.astype(np.int32)),
                    pa.array(found.owned.astype(np.int32)),
                ],
                ["seed", "context", "_d", "_t", "low", "owned"],
            )


def _emit_windows(batch: pa.RecordBatch, length: int, k: int) -> Iterator[pa.RecordBatch]:
    """The owned windows' hashes of the anchors named in `lows` (first owned windows)."""
    for part in slices(batch, "text"):
        found = _Anchors(Texts(part["text"]), length, k)
        lows = part["lows"]
        doc_of = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lows.offsets)))
        wanted = np.asarray(lows.flatten()).astype(np.int64) + found.words.first[doc_of]
        rows = np.flatnonzero(np.isin(found.starts[found.row], wanted))
        if len(rows):
            owned, row = found.owned[rows], found.row[rows]
            ends = np.cumsum(owned)
            at = np.arange(ends[-1]) - np.repeat(ends - owned, owned) + np.repeat(row, owned)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            hashes = pa.ListArray.from_arrays(offsets, pa.array(as_signed(found.hashes[at])))
            yield pa.record_batch([pa.array(as_signed(found.seed[rows])), pa.array(as_signed(found.context[rows])), hashes], ["seed", "context", "hashes"])


def _strip(batch: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, "text"):
        words = Words(Texts(part["text"]), SPACED)
        change = np.zeros(len(words) + 1, np.int64)
        lows, masks = part["lows"], part["masks"]
        counts = np.diff(np.asarray(lows.offsets)) if len(lows) else np.zeros(0, np.int64)
        doc_of = np.repeat(np.arange(part.num_rows), counts)
        low = np.asarray(lows.flatten()).astype(np.int64) + words.first[doc_of]
        mask = np.asarray(masks.flatten()).astype(np.int64)
        for j in range(length):
            at = low[(mask >> j) & 1 == 1] + j
            if len(at):
                np.add.at(change, at, 1)
                np.add.at(change, at + length, -1)
        gone = np.cumsum(change)[:-1] > 0
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) if part.num_rows else np.zeros(0, np.int64)
        n_words = np.diff(words.first)
        removed[n_words == 0] = 0
        kept = np.flatnonzero(~gone)
        first = np.searchsorted(kept, words.first)
        data = words.data.tobytes()
        texts = []
        for i in range(part.num_rows):
            own = kept[first[i] : first[i + 1]]
            texts.append(b" ".join([data[a:b] for a, b in zip(words.start[own].tolist(), words.end[own].tolist(), strict=True)]))
        yield pa.record_batch(
            [
                part["doc_id"],
                pa.array(n_words.astype(np.int64)),
                pa.array(removed),
                pa.array([hashlib.sha256(x).hexdigest() for x in texts]),
                pa.array([x.decode("utf-8", "replace") for x in texts], pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def remove_repeats(docs: DataFrame, length: int = 35, k: int = 8, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Removes every word that lies in a window of `length` words whose sequence also starts anywhere else.

    Returns a row for each row of docs: doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined
    by one space; left out with with_text=False).

    Null or empty text: no words, nothing removed, the hash of the empty string. Texts shorter than a window keep
    all. Null or repeated ids are allowed: each row is a document of its own, so two equal rows repeat each other.
    Other columns of docs are ignored. `length` may be up to 62 + k words.
    """
    if not 1 <= k <= length or length - k + 1 > 63:
        raise ValueError("k must be within length, and a window may hold at most 63 k-grams")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = keyed(docs, id_col, text_col)
    anchors = scratch.store(
        arrow_map(rows.select("text", *KEY), lambda b: _emit_anchors(b, length, k), "seed long, context long, _d long, _t long, low int, owned int"),
        "anchors",
    )
    repeated = anchors.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1")).where("n > 1")
    # Stored first, so that nothing but the join reads the shuffled anchors and a hot seed's rows can be split.
    repeated = scratch.store(repeated.select("seed", (F.col("c0") != F.col("c1")).alias("several")), "seeds")
    found = scratch.store(anchors.join(repeated, "seed"), "repeated")
    scratch.drop("anchors")
    scratch.drop("seeds")
    full = F.expr("shiftrightunsigned(-1L, 64 - owned)")

    several = found.where("several")
    contexts = several.groupBy("seed", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "low")).alias("at"))
    contexts = scratch.store(contexts.select("seed", "context", "n", "at.*"), "contexts")
    wanted = scratch.store(contexts.groupBy(*KEY).agg(F.collect_list("low").alias("lows")), "wanted")
    texts = join_keyed(rows.select("text", *KEY), wanted, KEY, "inner")
    # Rows that share a key emit the same windows; one row of each context counts.
    emitted = arrow_map(texts.select("text", "lows"), lambda b: _emit_windows(b, length, k), "seed long, context long, hashes array<long>")
    hot = contexts.groupBy("seed").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HOT_CONTEXTS).select("seed", F.lit(True).alias("hot"))
    emitted = scratch.store(
        emitted.groupBy("seed", "context").agg(F.first("hashes").alias("hashes")).join(hot, "seed", "left").withColumn("hot", F.coalesce("hot", F.lit(False))),
        "windows",
    )
    scratch.drop("wanted")

    def masks(df: DataFrame) -> DataFrame:
        return df.groupBy("seed", "context").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask"))

    spread = lambda df: df.select("seed", "context", F.posexplode("hashes").alias("j", "hash"))
    cold = spread(emitted.where("not hot").repartition("seed")).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("seed", "hash")))
    cold = masks(cold.where("m > 1"))
    wide = spread(emitted.where("hot"))
    shared = wide.groupBy("seed", "hash").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("seed", "hash")
    partial = cold.unionByName(masks(wide.join(shared, ["seed", "hash"])))
    verdicts = contexts.select("seed", "context", "n").join(partial, ["seed", "context"], "left").where("n > 1 or mask is not null")
    # Stored like the seeds, so that a hot seed's rows can be split.
    verdicts = scratch.store(verdicts.select("seed", "context", F.col("n").alias("m"), F.coalesce("mask", F.lit(0).cast("long")).alias("mask")), "verdicts")
    covered = several.join(verdicts, ["seed", "context"]).select(*KEY, "low", F.when(F.col("m") > 1, full).otherwise(F.col("mask")).alias("mask"))
    covered = covered.unionByName(found.where("not several").select(*KEY, "low", full.alias("mask")))
    # Equal rows name the same places; copies of a row do not lengthen its list.
    covered = covered.groupBy(*KEY, "low").agg(F.bit_or("mask").alias("mask"))
    covered = scratch.store(covered.groupBy(*KEY).agg(F.collect_list(F.struct("low", "mask")).alias("at")), "covered")
    for name in ("repeated", "contexts", "windows", "verdicts"):
        scratch.drop(name)
    joined = join_keyed(rows, covered, KEY, "left")
    joined = joined.select(
        "doc_id",
        "text",
        F.coalesce(F.col("at.low"), F.expr("array()").cast("array<int>")).alias("lows"),
        F.coalesce(F.col("at.mask"), F.expr("array()").cast("array<long>")).alias("masks"),
    )
    id_type = joined.schema["doc_id"].dataType.simpleString()
    out = arrow_map(joined, lambda b: _strip(b, length), f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, 35, with_text=False)
