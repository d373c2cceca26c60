"""Words and runs of letters of the same texts, from one read of each text.

Texts reach Python once, in lower case, and are laid out as code points: which of these are in words, and what they are without
their accents, is a table that Spark's own expressions give, so that words are those of terms.tokens(). The vocabulary is guessed
on few texts; the guessed terms are then counted on all of them, and of all other terms the sums over ranges of their hashes. Where
such a sum is below the count of the last term chosen, no other term can be in the vocabulary. Else all terms are counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.functions.text import without_accents
from vellumflow.operators import hashed
from vellumflow.operators.hashed import Laid, Wanted
from vellumflow.operators.terms import STOP_WORDS, tokens

SIZES = {"w": (1, 2), "c": (3, 4, 5)}
#: About so many texts are read for a guess, of so many times the terms asked for.
GUESS_TEXTS, GUESS_TERMS = 4096, 4
#: Bits of the ranges of hashes over which other terms are summed.
RANGE_BITS = 15
_CODES, _GONE = 0x110000, 0x110000


def _stirred(x: np.ndarray) -> np.ndarray:
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(by)
    return x ^ (x >> np.uint64(33))


@dataclass
class Characters:
    """Of each code point: what it is without accents, _GONE where nothing is left, and (of what is left) whether it is in words."""

    plain: np.ndarray
    word: np.ndarray

    @staticmethod
    def asked(spark: SparkSession) -> Characters:
        """Asked once in an application."""
        name = spark.sparkContext.applicationId
        if name not in _tables:
            _tables.clear()
            _tables[name] = Characters._asked(spark)
        return _tables[name]

    @staticmethod
    def _asked(spark: SparkSession) -> Characters:
        # After a letter, as a byte order mark at the start would be left out.
        one = F.substring(F.decode(F.unhex(F.concat(F.lit("00000061"), F.lpad(F.hex("id"), 8, "0"))), "UTF-32"), 2, 1)
        seen = spark.range(_CODES).where("id < 55296 or id > 57343").select("id", one.alias("c")).select("id", "c", F.lower(without_accents("c")).alias("p"))
        # Two of them are a word where one can be in words.
        told = seen.select("id", F.when(F.length("p") > 0, F.ascii("p")).otherwise(_GONE).alias("to"), (F.size(tokens(F.concat("c", "c"), False)) > 0).alias("word"))
        rows = told.where("word or to <> id").toArrow()
        ids = rows["id"].to_numpy()
        plain, word = np.arange(_CODES + 1, dtype=np.uint32), np.zeros(_CODES + 1, bool)
        word[ids] = rows["word"].to_numpy()
        plain[ids] = rows["to"].to_numpy()
        return Characters(plain, word)


_tables: dict[str, Characters] = {}


def _runs(inside: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places inside, the number of each one's run within a text, and where runs start among these places."""
    at = np.flatnonzero(inside)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] - at[:-1] > 1) | (doc[at[1:]] != doc[at[:-1]])
    return at, np.cumsum(new) - 1, np.flatnonzero(new)


class Words(Laid):
    """Words of two letters or more without accents, but for stop words."""

    def __init__(self, codes: np.ndarray, doc: np.ndarray, rows: int, characters: Characters):
        self.rows, codes = rows, characters.plain[codes]
        if (codes == _GONE).any():
            codes, doc = codes[codes != _GONE], doc[codes != _GONE]
        at, run, starts = _runs(characters.word[codes], doc)
        self.letters, sizes = codes[at], np.diff(np.append(starts, len(at)))
        all_codes = self.hashes(self.letters, run, starts)
        ok = np.flatnonzero((sizes >= 2) & ~_stops().has(all_codes))
        self.codes, self.doc, self.start, self.end = all_codes[ok], doc[at[starts[ok]]], starts[ok], starts[ok] + sizes[ok]

    @staticmethod
    def hashes(letters: np.ndarray, run: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        place = (np.arange(len(letters)) - starts[run]).astype(np.uint64) << np.uint64(21)
        return _stirred(np.add.reduceat(_stirred(place + letters + np.uint64(1)), starts))

    def term(self, at: int, size: int) -> str:
        return " ".join("".join(map(chr, self.letters[self.start[i] : self.end[i]])) for i in range(at, at + size))

    @classmethod
    def hash_of(cls, term: str) -> int:
        return hashed._hash(np.concatenate([cls.of_word(w) for w in term.split(" ")]))

    @classmethod
    def of_word(cls, word: str) -> np.ndarray:
        return cls.hashes(np.array([ord(c) for c in word], np.uint32), np.zeros(len(word), np.int64), np.zeros(1, np.int64))


class _Stops:
    def __init__(self):
        self.codes = np.sort(np.concatenate([Words.of_word(w) for w in STOP_WORDS]))

    def has(self, codes: np.ndarray) -> np.ndarray:
        return self.codes[np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)] == codes


_made: list[_Stops] = []


def _stops() -> _Stops:
    if not _made:
        _made.append(_Stops())
    return _made[0]


#: White space, all of which is below this length.
_SPACE = np.array([chr(i).isspace() for i in range(0x3001)])


class Letters(hashed.Letters):
    """The letters of words between white space, as in hashed.Letters."""

    def __init__(self, codes: np.ndarray, doc: np.ndarray, rows: int, characters: Characters):
        at, run, starts = _runs(~((codes < len(_SPACE)) & _SPACE[np.minimum(codes, len(_SPACE) - 1)]), doc)
        sizes = np.diff(np.append(starts, len(at)))
        self.rows, self.letters, self.doc = rows, np.full(len(at) + 3 * len(starts), 32, np.uint32), np.repeat(doc[at[starts]], sizes + 3)
        self.letters[np.arange(len(at)) + 3 * run + 1] = codes[at]
        self.letters[np.cumsum(sizes + 3) - 1] = 0
        self.codes, self.fits = self._codes(self.letters), self.letters != 0


KINDS = {"w": Words, "c": Letters}


def slices(texts: pa.Array, characters: Characters) -> Iterator[dict[str, Laid]]:
    """Both layouts of slices of the texts."""
    a, room = 0, 0

    def laid(some: pa.Array) -> dict[str, Laid]:
        codes = np.frombuffer("".join(some.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(len(some)), pc.utf8_length(some).to_numpy(zero_copy_only=False))
        return {name: kind(codes, doc, len(some), characters) for name, kind in KINDS.items()}

    for i, n in enumerate(pc.binary_length(texts).to_numpy(zero_copy_only=False).tolist()):
        if i > a and (room + n > hashed.SLICE_BYTES or i - a >= GUESS_TEXTS):
            yield laid(texts.slice(a, i - a))
            a, room = i, 0
        room += n
    if a < len(texts):
        yield laid(texts.slice(a))


def lowered(text: str) -> Column:
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def _told(docs: DataFrame, text: str, sent, guessed: dict[str, list[str]]) -> dict[str, tuple[np.ndarray, np.ndarray, int]]:
    """For each block: df and cf of the guessed terms over all rows, and the largest sum over a range of the hashes of others."""
    hashes = docs.sparkSession.sparkContext.broadcast({b: np.array([KINDS[b].hash_of(t) for t in some], np.uint64) for b, some in guessed.items()})
    shift = np.uint64(64 - RANGE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {b: Wanted(h) for b, h in hashes.value.items()}
        sums = {b: np.zeros((2, len(w.hashes)), np.int64) for b, w in wanted.items()}
        others = {b: np.zeros(1 << RANGE_BITS, np.int64) for b in wanted}
        for batch in batches:
            for both in slices(batch["t"], sent.value):
                for b, laid in both.items():
                    size = len(wanted[b].hashes)
                    seen = np.zeros(laid.rows * size, bool)
                    for n in SIZES[b]:
                        at, h = laid.of(n)
                        places, numbers = wanted[b].found(h) if size else (at[:0], at[:0])
                        seen[laid.doc[at[places]] * size + numbers] = True
                        sums[b][1] += np.bincount(numbers, minlength=size)
                        others[b] += np.bincount((h >> shift).astype(np.int64), minlength=1 << RANGE_BITS) - np.bincount((h[places] >> shift).astype(np.int64), minlength=1 << RANGE_BITS)
                    sums[b][0] += seen.reshape(laid.rows, size).sum(axis=0)
        for b, (df, cf) in sums.items():
            for known, x, y in ((True, df, cf), (False, others[b], others[b])):
                there = np.flatnonzero(y)
                yield pa.record_batch([pa.array([b] * len(there), pa.string()), pa.array([known] * len(there), pa.bool_()), pa.array(there, pa.int32()), pa.array(x[there]), pa.array(y[there])], ["b", "known", "number", "df", "cf"])

    counts = docs.select(lowered(text).alias("t")).mapInArrow(run, "b string, known boolean, number int, df long, cf long").groupBy("b", "known", "number").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    rows = counts.toPandas()
    out = {}
    for b, some in guessed.items():
        own = rows[rows.b == b]
        known, rest = own[own.known], own[~own.known]
        df, cf = np.zeros((2, len(some)), np.int64)
        df[known.number], cf[known.number] = known.df, known.cf
        out[b] = df, cf, int(rest.cf.max()) if len(rest) else 0
    return out


def vocabulary(docs: DataFrame, text: str, kinds: dict[str, hashed.Terms], sizes: dict[str, int], n: int, min_df: int, max_df: int | float) -> dict[str, list[tuple[str, int]]]:
    """For each block the (term, df) that hashed.vocabulary() chooses, in order of the term. n: the number of rows."""
    sent = docs.sparkSession.sparkContext.broadcast(Characters.asked(docs.sparkSession))
    some = docs if n <= GUESS_TEXTS else docs.where(F.pmod(F.xxhash64(text), F.lit(n)) < GUESS_TEXTS)
    some = some.select(text).persist()
    guessed = {b: [r.term for r in hashed.vocabulary(some, text, kinds[b], GUESS_TERMS * sizes[b], 1, n).collect()] for b in KINDS}
    some.unpersist()
    out = {}
    for b, (df, cf, rest) in _told(docs, text, sent, guessed).items():
        fit = sorted((-int(c), t, int(d)) for t, d, c in zip(guessed[b], df, cf, strict=True) if min_df <= d <= max_df)[: sizes[b]]
        if rest and (len(fit) < sizes[b] or (fit and rest >= -fit[-1][0])):
            chosen = [(r.term, r.df) for r in hashed.vocabulary(docs, text, kinds[b], sizes[b], min_df, max_df).collect()]
        else:
            chosen = [(t, d) for _, t, d in fit]
        out[b] = sorted(chosen)
    return out


def features(docs: DataFrame, text: str, vocab: dict[str, list[tuple[str, float]]]) -> Column:
    """A row's index and value: in each block (1 + ln tf) * idf of its terms (term, idf), scaled to length 1; numbers count through the blocks."""
    spark = docs.sparkSession
    terms = {b: (np.array([KINDS[b].hash_of(t) for t, _ in vocab[b]], np.uint64), np.array([x for _, x in vocab[b]], float)) for b in KINDS}
    sent = spark.sparkContext.broadcast((Characters.asked(spark), terms))

    def of(both: dict[str, Laid], wanted: dict[str, Wanted], idf: dict[str, np.ndarray]) -> pa.Array:
        first, parts = 0, []
        for b, laid in both.items():
            size = len(idf[b])
            keys = []
            for n in SIZES[b] if size else ():
                at, h = laid.of(n)
                places, numbers = wanted[b].found(h)
                keys.append(laid.doc[at[places]] * size + numbers)
            key, tf = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)
            doc, number = np.divmod(key, max(size, 1))
            raw = (1 + np.log(tf)) * idf[b][number]
            length = np.sqrt(np.bincount(doc, raw * raw, laid.rows))
            parts.append((doc, number + first, raw / length[doc]))
            first += size
        doc, number, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(doc, kind="stable")
        starts = pa.array(np.searchsorted(doc[order], np.arange(both["w"].rows + 1)).astype(np.int32))
        lists = (pa.ListArray.from_arrays(starts, pa.array(x)) for x in (number[order].astype(np.int32), value[order]))
        return pa.StructArray.from_arrays(list(lists), ["index", "value"])

    @F.arrow_udf("struct<index:array<int>,value:array<double>>")
    def made(texts: pa.Array) -> pa.Array:
        characters, terms = sent.value
        wanted, idf = {b: Wanted(h) for b, (h, _) in terms.items()}, {b: x for b, (_, x) in terms.items()}
        kind = pa.struct([("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))])
        return pa.concat_arrays([pa.array([], kind), *(of(both, wanted, idf) for both in slices(texts, characters))])

    return made(lowered(text))
