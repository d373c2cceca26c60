"""Phrase collocations by contiguous pattern growth over projected occurrence pointers.

A word of a language is a 64-bit hash of both. Two passes over the texts count words and pairs, then triples of frequent
pairs; what is frequent goes round as a bitmap of fixed size. A bitmap may let too much through but never loses
anything, and triples that it lets through are counted by their words later on, so the bound on its size costs work and no results.

The third pass emits a pointer for each place where a frequent triple may begin: the words from there on, as far as their
triples may be frequent. Equal pointers are counted before they are shuffled. Pointers are then dealt by their first
word, sorted, and each prefix is grown depth-first inside one task: its pointers are a range of the sorted rows, its
extensions are subranges. A prefix with too many pointers for a task is counted by an aggregation instead and its
pointers are dealt by one word more, so that no task holds a hot prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.llm.common import Scratch, arrow_map, buckets, give_back, join_small
from vellumflow.llm.kernel import Texts, Words, as_signed, mix, slices, span_hashes

LEAST = 100
LONGEST = 5
TOP = 2000
#: Slots of a bitmap; as broadcast it has an eighth of it in bytes.
SLOTS = 1 << 26
#: Slots of a row that a bitmap is collected in, as bitmap_construct_agg has them.
ROW_SLOTS = 1 << 15
#: A prefix is hot beyond this many distinct pointers, if they are more than one part in SHARE of a partition's.
HOT = 20_000
SHARE = 2
#: Parts of a language that are ranked apart before the best of them are ranked together.
RANK_PARTS = 64
SLICE = 2 << 20
#: Pointers that a task holds before it hands them on.
BUFFER = 400_000

#: Bytes that end a piece, and bytes of words.
BREAKS = np.zeros(256, bool)
BREAKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
LETTERS = ~BREAKS
LETTERS[[0x20, 0x09]] = False


class Phrases:
    """The words of some texts as hashes of word and language, and which of them stand next to each other in one piece."""

    def __init__(self, part: pa.RecordBatch):
        texts = Texts(part["text"])
        self.words = Words(texts, LETTERS, lower=True)
        g = np.asarray(part["g"]).view(np.uint64)
        self.k = mix(span_hashes(self.words.data, self.words.start, self.words.end) ^ g[self.words.doc])
        self.k[self.k == 0] = 1
        n = len(self.words)
        gone = np.flatnonzero(BREAKS[texts.data])
        piece = np.searchsorted(gone, self.words.start)
        self.next = np.zeros(n, bool)
        self.next[:-1] = (piece[1:] == piece[:-1]) & (self.words.doc[1:] == self.words.doc[:-1])

    def grams(self, size: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the `size` words that begin at the given places."""
        out = np.full(len(at), size, np.uint64)
        for i in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + self.k[at + i])
        return out


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """As words are hashes already, their bits are enough; Spark computes the same."""
    return (first >> np.uint64(13)) ^ second


def _held(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which hashes a bitmap lets through."""
    slot = x & np.uint64(len(bits) * 8 - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _distinct(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of some columns and how often each is there, or the sums of their counts."""
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + c.view(np.uint64))
    _, first, of, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    # Rows of one key are equal; were they not, all would go out uncounted.
    if all((c == c[first][of]).all() for c in columns):
        return [as_signed(c[first]) for c in columns], (n if counts is None else np.bincount(of, counts, len(n))).astype(np.int64)
    return [as_signed(np.ascontiguousarray(c)) for c in columns], np.ones(len(key), np.int64) if counts is None else counts


def _words_and_pairs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(size, k0, k1, c): words of a language (size 0, k0 its hash), of each word (1) and each pair (2)."""
    for part in slices(batch, "text", SLICE):
        p = Phrases(part)
        languages, of = np.unique(np.asarray(part["g"]), return_inverse=True)
        totals = np.bincount(of, np.diff(p.words.first), len(languages)).astype(np.int64)
        (words,), n_words = _distinct([p.k])
        at = np.flatnonzero(p.next)
        (first, second), n_pairs = _distinct([p.k[at], p.k[at + 1]])
        size = np.repeat(np.array([0, 1, 2], np.int8), [len(languages), len(words), len(first)])
        columns = [size, np.concatenate([languages, words, first]), np.concatenate([np.zeros(len(languages) + len(words), np.int64), second]), np.concatenate([totals, n_words, n_pairs])]
        yield pa.record_batch([pa.array(c) for c in columns], ["size", "k0", "k1", "c"])


def _pairs_held(p: Phrases, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word whether it may be frequent, and whether the two pairs may be that begin there and at the next word."""
    some = _held(words, p.k)
    pair = p.next.copy()
    pair[:-1] &= some[:-1] & some[1:]
    at = np.flatnonzero(pair)
    pair[at] = _held(pairs, _pair_hash(p.k[at], p.k[at + 1]))
    both = pair.copy()
    both[:-1] &= pair[1:]
    both[-1:] = False
    return some, both


def _triples(batch: pa.RecordBatch, words: Broadcast, pairs: Broadcast) -> Iterator[pa.RecordBatch]:
    """(size, k, c, word, g): triples of frequent pairs (3); the letters and language of each frequent word (1, with c 0)."""
    for part in slices(batch, "text", SLICE):
        p = Phrases(part)
        some, both = _pairs_held(p, words.value, pairs.value)
        (k,), c = _distinct([p.grams(3, np.flatnonzero(both))])
        yield pa.record_batch([pa.array(np.full(len(k), 3, np.int8)), pa.array(k), pa.array(c), pa.nulls(len(k), pa.string()), pa.nulls(len(k), pa.int64())], ["size", "k", "c", "word", "g"])
        _, first = np.unique(p.k[some], return_index=True)
        at = np.flatnonzero(some)[first]
        start, end = p.words.start[at], p.words.end[at]
        offsets = np.concatenate([[0], np.cumsum(end - start)])
        letters = p.words.data[np.repeat(start - offsets[:-1], end - start) + np.arange(offsets[-1])]
        word = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(letters.tobytes())).cast(pa.string())
        g = np.asarray(part["g"])[p.words.doc[at]]
        yield pa.record_batch([pa.array(np.ones(len(at), np.int8)), pa.array(as_signed(p.k[at])), pa.array(np.zeros(len(at), np.int64)), word, pa.array(g)], ["size", "k", "c", "word", "g"])


def _pointers(p: Phrases, words: Broadcast, pairs: Broadcast, triples: Broadcast, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The words from each frequent triple on, as far as they may be part of a frequent phrase, then zeros; each with its count."""
    _, triple = _pairs_held(p, words.value, pairs.value)
    at = np.flatnonzero(triple)
    triple[at] = _held(triples.value, p.grams(3, at))
    at = np.flatnonzero(triple)
    columns, on = [p.k[at + i] for i in range(3)], np.ones(len(at), bool)
    for i in range(3, longest):
        # Word i belongs to it if the triple that ends there may be frequent, and all before it.
        on &= triple[np.minimum(at + i - 2, len(triple) - 1)]
        columns.append(np.where(on, p.k[np.minimum(at + i, len(triple) - 1)], np.uint64(0)))
    return _distinct(columns[:longest])


def _projected(rows: DataFrame, words: Broadcast, pairs: Broadcast, triples: Broadcast, longest: int) -> DataFrame:
    """(k0, k1, ..., c): the pointers of all texts. A task adds up equal ones of its texts, up to BUFFER at once, before it hands them on."""
    names = _names(longest)

    def run(batches):
        held, counts = [np.zeros(0, np.int64)] * longest, np.zeros(0, np.int64)
        out = lambda: pa.record_batch([*map(pa.array, held), pa.array(counts)], [*names, "c"])
        try:
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    columns, n = _pointers(Phrases(part), words, pairs, triples, longest)
                    held, counts = [np.concatenate(c) for c in zip(held, columns, strict=True)], np.concatenate([counts, n])
                    if len(counts) > BUFFER:
                        held, counts = _distinct(held, counts)
                        if len(counts) > BUFFER // 2:
                            yield out()
                            held, counts = [np.zeros(0, np.int64)] * longest, np.zeros(0, np.int64)
            held, counts = _distinct(held, counts)
            yield out()
        finally:
            give_back()

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", c long")


def _names(longest: int) -> list[str]:
    return [f"k{i}" for i in range(longest)]


def grown(rows: np.ndarray, counts: np.ndarray, least: int, depth: int) -> Iterator[tuple[int, int, int]]:
    """Frequent prefixes of sorted rows, depth-first from prefixes of `depth` words on: (a row that has it, its length, its count).

    The pointers of a prefix are a range of rows; those of its extensions by one word are the runs of that word in it.
    """
    total = np.concatenate([[0], np.cumsum(counts)])
    width = rows.shape[1]

    def runs(low: int, high: int, column: int) -> list[tuple[int, int]]:
        cuts = np.flatnonzero(rows[low + 1 : high, column] != rows[low : high - 1, column]) + low + 1
        starts, ends = np.concatenate([[low], cuts]), np.concatenate([cuts, [high]])
        some = (total[ends] - total[starts] >= least) & (rows[starts, column] != 0)
        return list(zip(starts[some].tolist(), ends[some].tolist(), strict=True))

    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :depth] != rows[:-1, :depth]).any(axis=1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(rows))
    enough = (total[ends] - total[starts] >= least) & (rows[starts, depth - 1] != 0)
    waiting = [(int(a), int(b), depth) for a, b in zip(starts[enough][::-1], ends[enough][::-1], strict=True)]
    while waiting:
        low, high, size = waiting.pop()
        yield low, size, int(total[high] - total[low])
        if size < width:
            waiting += [(a, b, size + 1) for a, b in reversed(runs(low, high, size))]


def _grown(pointers: DataFrame, names: list[str], depth: int, least: int) -> DataFrame:
    """Frequent phrases (k0 ..., size, f) of `depth` words and more; all pointers of a prefix of `depth` words are in one partition, sorted."""
    width = len(names)

    def phrases(rows: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        found = np.array(list(grown(rows, counts, least, depth)), np.int64).reshape(-1, 3)
        out = np.where(np.arange(width) < found[:, 1:2], rows[found[:, 0]], 0)
        return pa.record_batch([*(pa.array(out[:, i]) for i in range(width)), pa.array(found[:, 1].astype(np.int32)), pa.array(found[:, 2])], [*names, "size", "f"])

    def run(batches):
        rows, counts = np.zeros((0, width), np.int64), np.zeros(0, np.int64)
        try:
            for batch in batches:
                rows = np.concatenate([rows, np.stack([np.asarray(batch[c]) for c in names], axis=1)])
                counts = np.concatenate([counts, np.asarray(batch["c"])])
                # The last prefix may go on in the next batch.
                last = np.flatnonzero((rows[:, :depth] != rows[-1, :depth]).any(axis=1))
                whole = last[-1] + 1 if len(last) else 0
                if whole:
                    yield phrases(rows[:whole], counts[:whole])
                    rows, counts = rows[whole:], counts[whole:]
            if len(rows):
                yield phrases(rows, counts)
        finally:
            give_back()

    return pointers.select(*names, "c").mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", size int, f long")


def _bitmap(spark, hashes: DataFrame, slots: int) -> Broadcast:
    """A bitmap of the slots that the hashes (k) fall in; collected as rows of fixed size, at most slots / 8 bytes in all."""
    slot = F.col("k").bitwiseAND(F.lit(slots - 1))
    rows = hashes.groupBy(F.shiftright(slot, 15).alias("row")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(ROW_SLOTS - 1))).alias("bits"))
    bits = np.zeros(max(slots, ROW_SLOTS) // 8, np.uint8)
    for r in rows.collect():
        bits[r.row * ROW_SLOTS // 8 : (r.row + 1) * ROW_SLOTS // 8] = np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast(bits[: slots // 8])


def frequent_phrases(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST, slots: int = SLOTS, hot: int = HOT, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to `longest` words that stand `least` times or more in texts of one language, and the words.

    The first table has k0, k1 ... (hashes of the words, zeros behind), size and f; the second k, word, lang, n (words of
    that language).
    """
    if longest < 2:
        raise ValueError("phrases have two words or more")
    spark = docs.sparkSession
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.xxhash64(lang).alias("g"))
    names = _names(longest)

    counted = arrow_map(rows, _words_and_pairs, "size tinyint, k0 long, k1 long, c long").groupBy("size", "k0", "k1").agg(F.sum("c").alias("c"))
    counted = scratch.store(counted.where(f"size = 0 or c >= {least}"), "counted")
    words = _bitmap(spark, counted.where("size = 1").select(F.col("k0").alias("k")), slots)
    pairs = _bitmap(spark, counted.where("size = 2").select(F.shiftrightunsigned("k0", 13).bitwiseXOR(F.col("k1")).alias("k")), slots)
    triples = arrow_map(rows, lambda b: _triples(b, words, pairs), "size tinyint, k long, c long, word string, g long")
    triples = triples.groupBy("size", "k").agg(F.sum("c").alias("c"), F.min("word").alias("word"), F.min("g").alias("g"))
    triples = scratch.store(triples.where(f"size = 1 or c >= {least}"), "triples")
    longer = _bitmap(spark, triples.where("size = 3"), slots)
    pointers = _projected(rows, words, pairs, longer, longest)
    pointers = scratch.store(pointers.groupBy(*names).agg(F.sum("c").alias("c")), "pointers")
    for sent in (words, pairs, longer):
        sent.destroy()

    total = pointers.count()
    hot = max(hot, total // (SHARE * buckets(spark)))
    found, left = [], pointers
    for depth in range(1, longest + 1):
        prefix = names[:depth]
        many = scratch.store(left.groupBy(*prefix).agg(F.count(F.lit(1)).alias("m"), F.sum("c").alias("f")).where(f"m > {hot}"), f"hot_{depth}")
        own = left.join(F.broadcast(many.select(*prefix)), prefix, "left_anti")  # at most total / hot rows
        own = own.repartition(buckets(spark), *prefix).sortWithinPartitions(*names)
        found.append(_grown(own, names, depth, least))
        if not many.limit(1).count():
            break
        # What is hot is counted already; its pointers go on by one word more.
        rest = [F.lit(0).cast("long").alias(c) for c in names[depth:]]
        found.append(many.where(f"f >= {least} and {prefix[-1]} <> 0").select(*prefix, *rest, F.lit(depth).alias("size"), "f"))
        left = scratch.store(left.join(F.broadcast(many.select(*prefix)), prefix, "left_semi"), f"left_{depth}")
    phrases = found[0]
    for f in found[1:]:
        phrases = phrases.unionByName(f)
    # Words and pairs are counted by the first pass.
    zeros = [F.lit(0).cast("long").alias(c) for c in names[2:]]
    short = counted.where(f"size between 1 and least(2, {longest})").select("k0", "k1", *zeros, F.col("size").cast("int").alias("size"), F.col("c").alias("f"))
    phrases = scratch.store(phrases.where("size > 2").unionByName(short), "phrases")

    languages = docs.select(lang.alias("lang")).distinct().select("lang", F.xxhash64("lang").alias("g"))
    languages = scratch.store(languages.join(counted.where("size = 0").select(F.col("k0").alias("g"), F.col("c").alias("n")), "g"), "languages")
    words = join_small(triples.where("size = 1").select("k", "word", "g"), languages, ["g"], "inner", 64)
    return phrases, scratch.store(words.select("k", "word", "lang", "n"), "words")


def ratio() -> Column:
    """floor(1000 * f * n / (l * r)), exactly: products have up to 38 digits, and the quotient is at most 1000 * n / l."""
    f, n, left, right = (f"cast({c} as decimal(19,0))" for c in "fnlr")
    return F.expr(f"cast(1000 as decimal(4,0)) * {f} * {n} div ({left} * {right})")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, slots: int = SLOTS, hot: int = HOT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best collocations of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut at `.,;:!?` and line ends into pieces and at blanks and tabs into words. a = f(phrase) is
    how often it stands within pieces, n the language's words. Of all cuts of a phrase in two, with frequencies l and r,
    the one of least floor(1000 * a * n / (l * r)) counts, of equal ones the shortest first part. A phrase within a
    longer one that stands as often as itself is left out. Ranks are by score and a, descending, then phrase.

    A null text is empty; a null language is `und`. Rows are counted one by one, repeated ones too. Long texts are read whole.
    An empty table has no rows. Other columns are ignored. Words are told apart by 64-bit hashes of word and language.
    """
    scratch = Scratch(docs.sparkSession)
    phrases, words = frequent_phrases(docs, scratch, least, longest, slots, hot, text_col, lang_col)
    names = _names(longest)
    zero = F.lit(0).cast("long")

    def part(first, size) -> list:
        """Columns of the words first .. first + size - 1, then zeros."""
        every = F.array(*names)
        return [F.when(F.lit(i) < size, F.get(every, first + i)).otherwise(zero) for i in range(longest)]

    # A phrase that stands as often as a longer one has a word more of it that stands as often, too.
    longer = phrases.where("size > 2")
    ends = [longer.select(*(c.alias(x) for c, x in zip(part(F.lit(i), F.col("size") - 1), names, strict=True)), "f") for i in (0, 1)]
    left = phrases.where("size > 1").join(ends[0].unionByName(ends[1]), [*names, "f"], "left_anti")

    cuts = left.select(*names, "size", "f", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    for side, columns in (("l", part(F.lit(0), F.col("cut"))), ("r", part(F.col("cut"), F.col("size") - F.col("cut")))):
        keys = [f"{side}{i}" for i in range(longest)]
        cuts = cuts.select("*", *(c.alias(x) for c, x in zip(columns, keys, strict=True)))
        cuts = cuts.join(phrases.select(*(F.col(n).alias(x) for n, x in zip(names, keys, strict=True)), F.col("f").alias(side)), keys).drop(*keys)
    cuts = cuts.join(words.select(F.col("k").alias("k0"), "lang", "n"), "k0")
    best = cuts.groupBy(*names, "size", "f", "lang", "n").agg(F.min(F.struct(ratio().alias("score"), "cut", "l", "r")).alias("b"))
    best = best.select("lang", "n", F.col("f").alias("a"), "b.score", "b.l", "b.r", F.struct(*names).alias("id"), F.slice(F.array(*names), F.lit(1), F.col("size")).alias("p"))
    spelt = best.select("*", F.posexplode("p").alias("i", "k")).join(words.select("k", "word"), "k")
    spelt = spelt.groupBy("id", "lang", "n", "a", "score", "l", "r").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    spelt = spelt.select("lang", F.concat_ws(" ", F.transform("w", lambda x: x["word"])).alias("phrase"), "a", "l", "r", "n", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = spelt.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(f"rank <= {top}")
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(f"rank <= {top}")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))
