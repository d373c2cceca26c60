"""TF-IDF by hashes of terms: runs of letters, or of words.

Terms are counted as 64-bit hashes, added up per slice of texts before Spark sums them over all tasks, so that what is shuffled
grows with the distinct terms of a task and not with the entries of its texts. Only those that can get into the vocabulary are spelt.
Weights are then made text by text, as a text and the bounded vocabulary are all they need: no row for each entry is made, shuffled
or stored. No Python code runs per run of letters or words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.operators.terms import one_text, tokens
from vellumflow.sources.shared import run_folder

#: Bytes of a batch that are laid out at once; a longer text is alone.
SLICE_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a hash that tell most hashes apart from the wanted ones.
_MARKS = 18
#: One in so many rows is looked through first for the letters of hashes.
FIRST_SHARE = 8
ENTRIES = "array<struct<number:int,weight:double>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Laid:
    """Letters or words of `rows` texts, one after the other. doc: each one's text; codes: each one's hash; fits: whether it can be in a term."""

    rows: int
    doc: np.ndarray
    codes: np.ndarray
    fits: np.ndarray | None = None

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the terms of `size` letters or words, in order of their texts."""
        n = len(self.codes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inside, h = self.doc[:n] == self.doc[size - 1 :], np.full(n, size, np.uint64)
        for i in range(size):
            h = h * _ODD + self.codes[i : i + n]
            if self.fits is not None:
                inside &= self.fits[i : i + n]
        at = np.flatnonzero(inside)
        return at, _mixed(h[at])

    def term(self, at: int, size: int) -> str:
        raise NotImplementedError


class Letters(Laid):
    """The letters of words that are padded by one blank on both sides; 0 stands between words."""

    def __init__(self, texts: pa.Array):
        self.rows = len(texts)
        split = [t.split() for t in texts.to_pylist()]
        self.letters = np.frombuffer("".join(f" {w} \0" for some in split for w in some).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.doc = np.repeat(np.arange(len(split)), [sum(map(len, some)) + 3 * len(some) for some in split])
        self.codes, self.fits = self._codes(self.letters), self.letters != 0

    @staticmethod
    def _codes(letters: np.ndarray) -> np.ndarray:
        return _mixed(letters.astype(np.uint64) + np.uint64(1))

    def term(self, at: int, size: int) -> str:
        return "".join(map(chr, self.letters[at : at + size]))

    @staticmethod
    def bytes_of(texts: pa.Array) -> np.ndarray:
        return pc.binary_length(texts).to_numpy(zero_copy_only=False)

    @classmethod
    def hash_of(cls, term: str) -> int:
        return _hash(cls._codes(np.array([ord(c) for c in term], np.uint32)))


class Words(Laid):
    """Given words."""

    def __init__(self, texts: pa.Array):
        self.rows, self.words = len(texts), texts.flatten()
        self.doc = np.repeat(np.arange(len(texts)), pc.list_value_length(texts).to_numpy(zero_copy_only=False))
        told = self.words.dictionary_encode()
        self.codes = self._codes(told.dictionary.to_pylist())[told.indices.to_numpy(zero_copy_only=False)] if len(self.words) else np.zeros(0, np.uint64)

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        return pd.util.hash_array(np.array(words, object), categorize=False)

    def term(self, at: int, size: int) -> str:
        return " ".join(self.words.slice(at, size).to_pylist())

    @staticmethod
    def bytes_of(texts: pa.Array) -> np.ndarray:
        return pc.list_value_length(texts).to_numpy(zero_copy_only=False) * 8

    @classmethod
    def hash_of(cls, term: str) -> int:
        return _hash(cls._codes(term.split(" ")))


def _hash(codes: np.ndarray) -> int:
    h = np.full(1, len(codes), np.uint64)
    for c in codes:
        h = h * _ODD + c
    return int(_mixed(h)[0])


class Terms:
    """Terms of least..most letters or words; column: what is read of a row."""

    def __init__(self, kind: type[Letters] | type[Words], column: Callable[[Column], Column], least: int, most: int):
        self.kind, self.column, self.sizes = kind, column, range(least, most + 1)

    def slices(self, texts: pa.Array) -> Iterator[Laid]:
        """The rows' texts laid out in slices."""
        a, room = 0, 0
        for i, n in enumerate(self.kind.bytes_of(texts).tolist()):
            if i > a and room + n > SLICE_BYTES:
                yield self.kind(texts.slice(a, i - a))
                a, room = i, 0
            room += n
        if a < len(texts):
            yield self.kind(texts.slice(a))


def letter_runs(least: int = 3, most: int = 5) -> Terms:
    """Runs of letters of lower-cased words, padded by one blank on both sides."""
    return Terms(Letters, lambda text: F.lower(F.coalesce(text, F.lit(""))), least, most)


def word_runs(least: int, most: int, change: Callable[[Column], Column] = lambda text: text) -> Terms:
    """Runs of the tokens of texts, changed before."""
    return Terms(Words, lambda text: F.coalesce(tokens(change(text)), F.array().cast("array<string>")), least, most)


def _added(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, in how many texts each is, and how often."""
    at, distinct = pd.factorize(h)
    pairs = np.sort(at << 32 | doc)
    first = np.concatenate([[True], pairs[1:] != pairs[:-1]])
    return distinct, np.bincount(pairs[first] >> 32, minlength=len(distinct)), np.bincount(at)


def counted(docs: DataFrame, text: str, terms: Terms) -> DataFrame:
    """h, df, cf: in how many rows each term is, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for laid in terms.slices(batch["t"]):
                for n in terms.sizes:
                    at, h = laid.of(n)
                    if len(at):
                        h, df, cf = _added(laid.doc[at], h)
                        yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(df.astype(np.int64)), pa.array(cf.astype(np.int64))], ["h", "df", "cf"])

    parts = docs.select(terms.column(F.col(text)).alias("t")).mapInArrow(run, "h long, df long, cf long")
    return parts.groupBy("h").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


class Wanted:
    """Hashes to look for, and their places in the order given."""

    def __init__(self, hashes: np.ndarray):
        self.number = np.argsort(hashes)
        self.hashes = hashes[self.number]
        self.marks = np.zeros(1 << _MARKS, bool)
        self.marks[self.hashes & np.uint64((1 << _MARKS) - 1)] = True

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h of wanted ones, and the number of each."""
        some = np.flatnonzero(self.marks[h & np.uint64((1 << _MARKS) - 1)])
        place = np.searchsorted(self.hashes, h[some])
        hit = (place < len(self.hashes)) & (self.hashes[np.minimum(place, len(self.hashes) - 1)] == h[some])
        return some[hit], self.number[place[hit]]


def spelt(docs: DataFrame, text: str, terms: Terms, hashes: np.ndarray) -> list[tuple[int, str]]:
    """Each hash with its term. As terms that are asked for are frequent ones, a share of the rows is looked through first, and all rows only for what is missing then."""
    found: dict[int, str] = {}
    for rows in (docs.where(F.pmod(F.xxhash64(text), F.lit(FIRST_SHARE)) == 0), docs):
        missing = hashes[~np.isin(hashes, np.array(list(found), np.uint64))]
        if len(missing):
            found |= {r.h % 2**64: r.term for r in _spelt(rows, text, terms, missing).collect()}
    return [(int(h), found[int(h)]) for h in hashes]


def _spelt(docs: DataFrame, text: str, terms: Terms, hashes: np.ndarray) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted(sent.value)
        seen = np.zeros(len(wanted.hashes), bool)
        for batch in batches:
            for laid in terms.slices(batch["t"]):
                for n in () if seen.all() else terms.sizes:
                    at, h = laid.of(n)
                    places, numbers = wanted.found(h)
                    new, first = np.unique(numbers, return_index=True)
                    first, new = first[~seen[new]], new[~seen[new]]
                    seen[new] = True
                    if len(new):
                        told = [laid.term(int(a), n) for a in at[places[first]]]
                        yield pa.record_batch([pa.array(h[places[first]].view(np.int64)), pa.array(told, pa.string())], ["h", "term"])

    rows = docs.select(terms.column(F.col(text)).alias("t")).mapInArrow(run, "h long, term string")
    return rows.groupBy("h").agg(F.min("term").alias("term"))


def vocabulary(docs: DataFrame, text: str, terms: Terms, size: int, min_df: int, max_df: int | float) -> DataFrame:
    """term, df, cf of the `size` terms with most occurrences among those in min_df rows and max_df at most; equal ones in order of the term.

    Texts are counted in one pass and read once more for the letters of the hashes that may be in the vocabulary: those with at least as
    many occurrences as the last one that is.
    """
    spark = docs.sparkSession
    path = run_folder(spark, "terms")
    counted(docs, text, terms).where((F.col("df") >= min_df) & (F.col("df") <= max_df)).write.parquet(path)
    stats = spark.read.schema("h long, df long, cf long").parquet(path)
    # `size` numbers at most.
    last = stats.orderBy(F.desc("cf")).limit(size).agg(F.min("cf")).head()[0]
    survivors = stats.where(F.col("cf") >= F.lit(last if last is not None else 0))
    hashes = survivors.select("h").toArrow()["h"].to_numpy().view(np.uint64)
    if not len(hashes):
        return spark.createDataFrame([], "term string, df long, cf long")
    names = [(h - 2**64 if h >= 2**63 else h, term) for h, term in spelt(docs, text, terms, hashes)]
    rows = survivors.join(F.broadcast(spark.createDataFrame(names, "h long, term string")), "h")
    return rows.orderBy(F.desc("cf"), "term").limit(size).select("term", "df", "cf")


def weights(docs: DataFrame, text: str, terms: Terms, vocab: list[tuple[str, float]], first: int = 0) -> Column:
    """A row's entries (number, weight): (1 + ln tf) * idf of each term of vocab (term, idf), scaled to length 1; numbers count from `first`."""
    hashes, idf = np.array([terms.kind.hash_of(t) for t, _ in vocab], np.uint64), np.array([x for _, x in vocab], float)
    sent = docs.sparkSession.sparkContext.broadcast((hashes, idf))

    def of(laid: Laid, wanted: Wanted, idf: np.ndarray) -> pa.Array:
        keys = []
        for n in terms.sizes:
            at, h = laid.of(n)
            places, numbers = wanted.found(h)
            keys.append(laid.doc[at[places]] * len(idf) + numbers)
        key, tf = np.unique(np.concatenate(keys), return_counts=True)
        doc, number = np.divmod(key, len(idf))
        raw = (1 + np.log(tf)) * idf[number]
        starts = np.searchsorted(doc, np.arange(laid.rows + 1))
        length = np.sqrt(np.bincount(doc, raw * raw, laid.rows))
        entries = pa.StructArray.from_arrays([pa.array((number + first).astype(np.int32)), pa.array(raw / length[doc])], ["number", "weight"])
        return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), entries)

    @F.arrow_udf(ENTRIES)
    def entries(texts: pa.Array) -> pa.Array:
        hashes, idf = sent.value
        kind = pa.list_(pa.struct([("number", pa.int32()), ("weight", pa.float64())]))
        if not len(hashes):
            return pa.array([[]] * len(texts), kind)
        wanted = Wanted(hashes)
        return pa.concat_arrays([pa.array([], kind), *(of(laid, wanted, idf) for laid in terms.slices(texts))])

    return entries(terms.column(F.col(text)))


def idf(n: int) -> Column:
    """Of a term in df of n rows."""
    return F.log((F.lit(1.0) + n) / (1 + F.col("df"))) + 1


def tfidf(docs: DataFrame, key: str, text: str, terms: Terms, size: int, min_df: int = 2, max_df: float = 0.995) -> DataFrame:
    """key, term, weight over the `size` terms with most occurrences, equal ones in order of the term.

    Rows of one key are one text; terms lie in one line. The vocabulary, and no more, passes through the driver.
    """
    n = docs.count()
    whole = one_text(docs, key, text)
    vocab = [(r.term, r.idf) for r in vocabulary(whole, text, terms, size, min_df, max_df * n).select("term", idf(n).alias("idf")).orderBy("term").collect()]
    names = docs.sparkSession.createDataFrame([(i, term) for i, (term, _) in enumerate(vocab)], "number int, term string")
    entries = whole.select(key, weights(whole, text, terms, vocab).alias("_e")).select(key, F.explode("_e").alias("_x")).select(key, "_x.*")
    return entries.join(F.broadcast(names), "number").select(key, "term", "weight")
