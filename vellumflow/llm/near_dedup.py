"""Near-duplicate documents by HyperMinHash sketches, banded registers and links confirmed on full shingle sets.

A sketch splits the hashes of a shingle set over REGISTERS buckets; of each bucket's smallest hash it keeps the
count of leading zeros (6 bits) and the next MANTISSA bits. Empty registers take another register's value by a
fixed probe order. Classes (equal shingle sets) that share a band of registers are candidates: a first round compares
each with the first document of its bands, later rounds compare only across components that
share a band, until no such pair is left, so nothing is capped. In these rounds classes that share a band meet at
their rare shingles instead of the band itself: sets that reach the threshold share one of the first shingles of
each, rarest first, so a family of copies that are unlike each other makes no pairs. Sketches give a
collision-corrected estimate; pairs whose estimate could reach the threshold are confirmed on the sets. Components
come from star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.llm.common import KEY, Scratch, arrow_map, join_small, keyed
from vellumflow.llm.kernel import SPACED, Texts, Words, as_signed, mix, prefix, range_hash, slices, windows

REGISTERS = 128
MANTISSA = 10
ROWS = 4
BANDS = REGISTERS // ROWS
PROBES = 64
#: How many standard errors an estimate may fall short.
SLACK = 4.5
#: Chance that registers of different minima agree, for MANTISSA bits (sets of like size).
COLLISION = 0.17 * 2.0**-MANTISSA
EMPTY = 0xFFFF
#: Outsiders of a shingle that are compared in the first of the later rounds.
FIRST_REPS = 256


@lru_cache(maxsize=1)
def _probe_order() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(77))
    return np.stack([rng.integers(0, REGISTERS, REGISTERS) for _ in range(PROBES)])


class Shingles:
    """The distinct shingle hashes of some texts, sorted by text and hash; first: index of each text's first."""

    def __init__(self, texts: Texts, size: int):
        words = Words(texts, SPACED, lower=True)
        total = prefix(words.hashes())
        at, grams = windows(words, total, size)
        doc = words.doc[at]
        n = np.diff(words.first)
        short = np.flatnonzero((n > 0) & (n < size))
        doc = np.concatenate([doc, short])
        grams = np.concatenate([grams, range_hash(total, words.first[short], words.first[short + 1])])
        x = mix(grams + np.uint64(0x5851F42D4C957F2D))
        order = np.lexsort((x, doc))
        x, doc = x[order], doc[order]
        new = np.ones(len(x), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (x[1:] != x[:-1])
        self.x, self.doc = x[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(texts.n + 1))


def registers(x: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sketches (n rows of uint16) of hashes sorted by doc and hash; rows without hashes stay EMPTY."""
    bits = REGISTERS.bit_length() - 1
    bucket = (x >> np.uint64(64 - bits)).astype(np.int64)
    lead = np.ones(len(x), bool)
    lead[1:] = (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])
    rest = x[lead] << np.uint64(bits)
    zeros = (53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]).astype(np.uint64)
    value = (zeros << np.uint64(MANTISSA)) | ((rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA))
    out = np.full((n, REGISTERS), EMPTY, np.uint16)
    out[doc[lead], bucket[lead]] = value
    some = np.flatnonzero((out != EMPTY).any(axis=1) & (out == EMPTY).any(axis=1))
    whole = out[some]
    filled = whole.copy()
    for order in _probe_order():
        gaps = filled == EMPTY
        if not gaps.any():
            break
        filled = np.where(gaps, whole[:, order], filled)
    filled = np.where(filled == EMPTY, whole.min(axis=1, initial=EMPTY)[:, None], filled)
    out[some] = filled
    return out


def _sketch(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, "text"):
        texts = Texts(part["text"])
        found = Shingles(texts, size)
        n = np.diff(found.first)
        sums, xors = np.zeros(texts.n, np.uint64), np.zeros(texts.n, np.uint64)
        some = np.flatnonzero(n)
        if len(some):
            at = found.first[some]
            sums[some] = np.add.reduceat(mix(found.x + np.uint64(1)), at)
            xors[some] = np.bitwise_xor.reduceat(mix(found.x + np.uint64(2)), at)
        sketches = registers(found.x, found.doc, texts.n).astype("<u2").tobytes()
        step = 2 * REGISTERS
        yield pa.record_batch(
            [
                part["doc_id"],
                part["_d"],
                part["_t"],
                pa.array(n.astype(np.int64)),
                pa.array(as_signed(mix(sums ^ mix(xors + n.astype(np.uint64))))),
                pa.array([sketches[i * step : (i + 1) * step] for i in range(texts.n)], pa.binary()),
            ],
            ["doc_id", *KEY, "n", "c", "sketch"],
        )


def _emit_sets(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, "text"):
        found = Shingles(Texts(part["text"]), size)
        yield pa.record_batch([part["c"], pa.ListArray.from_arrays(pa.array(found.first.astype(np.int32)), pa.array(as_signed(found.x)))], ["c", "members"])


def _emit_shingles(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, "text"):
        found = Shingles(Texts(part["text"]), size)
        yield pa.record_batch([part["c"].take(pa.array(found.doc)), pa.array(as_signed(found.x))], ["c", "x"])


def _estimates(batch: pa.RecordBatch, threshold: float) -> Iterator[pa.RecordBatch]:
    """Keeps pairs that share a band and whose Jaccard similarity could reach the threshold; adds the estimate."""
    a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("sketch1", "sketch2"))
    same = a == b
    banded = same.reshape(-1, BANDS, ROWS).all(axis=2).any(axis=1)
    n1, n2 = np.asarray(batch["n1"]), np.asarray(batch["n2"])
    smaller, larger = np.minimum(n1, n2), np.maximum(n1, n2)
    estimate = np.clip((same.mean(axis=1) - COLLISION) / (1 - COLLISION), 0, 1)
    error = np.sqrt(threshold * (1 - threshold) / np.minimum(REGISTERS, smaller))
    keep = banded & (smaller >= threshold * larger * (1 - 1e-9)) & (estimate >= threshold - SLACK * error)
    yield pa.record_batch([batch["c1"], batch["c2"], pa.array(estimate)], ["c1", "c2", "estimate"]).filter(pa.array(keep))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(c, root) of every node in edges (c1, c2), by alternating large and small stars; root is the smallest node.

    Each step only groups by node for a minimum and joins it back, so a node with many links is no hot group.
    """
    step = 0
    pairs = edges.select(F.greatest("c1", "c2").alias("u"), F.least("c1", "c2").alias("v")).where("u <> v").distinct()
    pairs = scratch.store(pairs, f"{name}_0")
    while True:
        ends = pairs.select(F.col("u").alias("c"), F.lit(1).alias("u")).union(pairs.select("v", F.lit(0)))
        ends = ends.groupBy("c").agg(F.sum("u").alias("links"), F.min("u").alias("least"))
        # Stars only: a node has one link to a smaller one, or is the smallest of all its links.
        if not ends.where("links > 1 or (links = 1 and least = 0)").limit(1).count():
            break
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: neighbours above u go to the least of u and its neighbours
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its neighbours below u go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        step += 1
        pairs = scratch.store(small.where("u <> v").distinct(), f"{name}_{step}")
        scratch.drop(f"{name}_{step - 1}")
    return pairs.select(F.col("u").alias("c"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links rows whose sets of `size`-word shingles have a Jaccard similarity of at least percent / 100.

    Returns a row for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id of its component),
    kept (doc_id = component_id) and the row key _d, _t.

    Texts with fewer words have one shingle, all their words; null, empty or blank texts have none and no links.
    Equal texts are one class and are never paired. Rows with one id and different texts are separate. A component
    whose ids are all null has a null component_id and keeps its rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    sketches = scratch.store(arrow_map(rows, lambda b: _sketch(b, size), f"doc_id {kind}, _d long, _t long, n long, c long, sketch binary"), "sketches")
    classes = sketches.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("label"), F.min(F.struct("n", *KEY, "sketch")).alias("r"))
    classes = scratch.store(classes.select("c", "label", "r.*"), "classes")

    band = F.array(*(F.xxhash64(F.lit(b), F.substring("sketch", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)))
    # The first document of a band leads it: copies resemble what they were made from more than each other.
    banded = classes.select(F.explode(band).alias("g"), "c", "label", "n")
    crowded = banded.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("label", "c")).alias("lead")).where("m > 1")
    # Stored, so that nothing but the join reads the shuffled bands and a hot one can be split.
    crowded = scratch.store(crowded.select("g", F.col("lead.c").alias("rep")), "crowded")
    members = scratch.store(banded.select("g", "c", "n").join(crowded, "g"), "members")

    sizes = classes.select("c", "n", "sketch")

    def estimated(pairs: DataFrame) -> DataFrame:
        one = sizes.select(F.col("c").alias("c1"), F.col("n").alias("n1"), F.col("sketch").alias("sketch1"))
        two = sizes.select(F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2"))
        return arrow_map(pairs.join(one, "c1").join(two, "c2"), lambda b: _estimates(b, percent / 100), "c1 long, c2 long, estimate double")

    def texts_of(wanted: DataFrame, name: str) -> DataFrame:
        """(c, text) of the classes in wanted (c), which are distinct."""
        stored = scratch.store(wanted.join(classes.select("c", *KEY), "c"), f"{name}_wanted")
        return join_small(rows.select("text", *KEY), stored, KEY, "inner", 80).select("c", "text")

    def rare_places(members: DataFrame, roots: DataFrame) -> DataFrame:
        """Rare shingles (g) of the classes in bands with several components; s: shared shingles of the class from this one on.

        Shingles are ordered by how many of these classes have them; those that only one has come first and are left
        out, as no pair meets there. Only places from which the threshold can still be reached are kept.
        """
        placed = scratch.store(with_roots(members, roots), "placed_0")
        mixed = scratch.store(placed.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("g"), "bands")
        there = scratch.store(placed.join(mixed, "g").select("c", "n").distinct(), "mixed")
        shingles = arrow_map(texts_of(there.select("c"), "mixed"), lambda b: _emit_shingles(b, size), "c long, x long")
        shingles = scratch.store(shingles, "shingles")
        common = shingles.groupBy("x").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("df"))
        common = common.where("low <> high").select("x", "df")
        own = Window.partitionBy("c")
        # Rows that are there twice have one rank.
        ranked = shingles.join(common, "x").withColumn("r", F.dense_rank().over(own.orderBy("df", "x")))
        ranked = ranked.select("x", "c", (F.max("r").over(own) - F.col("r") + 1).cast("long").alias("s"))
        places = join_small(ranked, there, ["c"], "inner", 40).where(f"100L * s >= {percent}L * n")
        places = scratch.store(places.select(F.col("x").alias("g"), "c", "n", "s"), "places")
        scratch.drop("shingles")
        return places

    def with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
        return join_small(members, roots, ["c"], "left", 40).withColumn("root", F.coalesce("root", "c"))

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (c1, c2; stored) that hold on full sets."""
        texts = texts_of(pairs.select(F.col("c1").alias("c")).union(pairs.select("c2")).distinct(), name)
        sets = scratch.store(arrow_map(texts, lambda b: _emit_sets(b, size), "c long, members array<long>"), f"{name}_sets")
        one = sets.select(F.col("c").alias("c1"), F.col("members").alias("m1"))
        two = sets.select(F.col("c").alias("c2"), F.col("members").alias("m2"))
        both = pairs.select("c1", "c2").join(two, "c2").join(one, "c1")
        both = both.select("c1", "c2", F.size("m1").alias("a"), F.size("m2").alias("b"), F.size(F.array_intersect("m1", "m2")).alias("i"))
        held = scratch.store(both.where(F.expr(f"100L * i >= {percent}L * (a + b - i)")).select("c1", "c2").distinct(), f"{name}_links")
        scratch.drop(f"{name}_sets")
        scratch.drop(f"{name}_wanted")
        return held

    pairs = estimated(members.where("c <> rep").select(F.col("c").alias("c2"), F.col("rep").alias("c1")).distinct())
    best = pairs.groupBy("c2").agg(F.max_by("c1", F.struct("estimate", -F.col("c1"))).alias("c1")).select("c1", "c2")
    tested = scratch.store(best, "pairs_0")
    roots = components(confirmed(tested, "round_0"), scratch, "stars_0")
    members = rare_places(members.drop("rep"), roots)
    turn, reps = 1, FIRST_REPS
    while True:
        placed = scratch.store(with_roots(members, roots), f"placed_{turn}")
        scratch.drop(f"placed_{turn - 1}")
        main = placed.groupBy("g", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("g")
        main = main.agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("most"), F.count(F.lit(1)).alias("roots"))
        main = scratch.store(main.where("roots > 1"), f"main_{turn}")
        mixed = placed.join(main, "g")
        left = F.col("all") - F.col("most")
        # All outsiders of a shingle where they are few; else as many as `reps`, more each turn.
        chosen = mixed.where("root <> main").where((left <= reps) | (F.pmod(F.xxhash64("c", F.lit(turn)), left) < reps))
        chosen = chosen.select("g", F.col("c").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("s").alias("sa"))
        # The set sizes there that an outsider could link with, then the classes of these sizes.
        sizes_there = mixed.groupBy("g", "n").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("s").alias("s"))
        enough = f"{100 + percent}L * least(sa, s) >= {percent}L * (na + n)"
        reach = chosen.join(sizes_there, "g").where(f"100L * least(na, n) >= {percent}L * greatest(na, n) and {enough} and (low <> ra or high <> ra)")
        across = reach.select("g", "n", "a", "ra", "na", "sa").join(mixed.select("g", "n", "c", "s", "root"), ["g", "n"]).where(f"ra <> root and {enough}")
        across = across.select(F.least("a", "c").alias("c1"), F.greatest("a", "c").alias("c2")).distinct()
        ordered = tested.select(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2"))
        fresh = scratch.store(across.join(ordered, ["c1", "c2"], "left_anti"), f"across_{turn}")
        waiting = main.where(left > reps).limit(1).count()
        if not fresh.limit(1).count():
            if not waiting:
                break
        else:
            tested = scratch.store(ordered.union(fresh), f"tested_{turn}")
            links = confirmed(scratch.store(estimated(fresh).select("c1", "c2"), f"pairs_{turn}"), f"round_{turn}")
            if links.limit(1).count():
                # links join components; a star over roots gives the new ones
                at = lambda side: roots.select(F.col("c").alias(side), F.col("root").alias(f"r{side}"))
                joined = links.join(at("c1"), "c1", "left").join(at("c2"), "c2", "left")
                joined = joined.select(F.coalesce("rc1", "c1").alias("c1"), F.coalesce("rc2", "c2").alias("c2"))
                tops = components(joined, scratch, f"stars_{turn}").select(F.col("c").alias("root"), F.col("root").alias("top"))
                nodes = roots.union(tops.select("root", F.col("root").alias("r"))).dropDuplicates(["c"])
                roots = scratch.store(nodes.join(tops, "root", "left").select("c", F.coalesce("top", "root").alias("root")).where("c <> root"), f"roots_{turn}")
        turn, reps = turn + 1, reps * 16
    ends = roots.union(roots.select("root", "root").distinct())
    labelled = classes.select("c", "label").join(ends, "c", "left")
    tops = labelled.where("root is not null").groupBy("root").agg(F.min("label").alias("top"))
    labelled = labelled.join(tops, "root", "left").select("c", F.coalesce("top", "label").alias("label"))
    out = sketches.select("doc_id", "n", "c", *KEY).join(labelled, "c", "left")
    component = F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), *KEY)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), *KEY)


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop(*KEY)
