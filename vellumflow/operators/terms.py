"""Terms: keywords, document frequencies and TF-IDF in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions.text import once

# English words that are no terms.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do "
    "does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself "
    "me more most my myself no nor not of off on once only or other ought our ours ourselves out over own same she should so some such than that the "
    "their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who "
    "whom why will with would you your yours yourself yourselves"
).split()
TOKEN = r"(?U)\b\w\w+\b"


def tokens(text: Column, stop: bool = True) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS)) if stop else words


def grams(words: Column, least: int = 1, most: int = 2) -> Column:
    """Runs of least..most words, joined by a space. The words are bound, as each run reads them."""

    def of(every: Column, n: int) -> Column:
        if n == 1:
            return every
        runs = F.transform(every, lambda w, i: F.when(i + n <= F.size(every), F.concat_ws(" ", *(F.get(every, i + j) for j in range(n)))))
        return F.filter(runs, lambda g: g.isNotNull())

    return once(words, lambda every: F.concat(*(of(every, n) for n in range(least, most + 1))))


def char_grams(text: Column, least: int = 3, most: int = 5) -> Column:
    """Character runs of each word padded by one space on both sides; a padded word shorter than n counts once for n."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")

    def runs(p: Column, n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(p) - n + 1)), lambda i: F.substring(p, i, F.lit(n)))
        return F.when((F.length(p) >= n) | F.lit(n == least), every).otherwise(F.array().cast("array<string>"))

    def of(w: Column) -> Column:
        return F.concat(*(runs(F.concat(F.lit(" "), w, F.lit(" ")), n) for n in range(least, most + 1)))

    return F.flatten(F.transform(words, of))


def keywords(text: Column, n: int = 12, most: int = 2) -> Column:
    """The n most frequent terms of 1..most words, equal counts in order of the term."""
    return once(tokens(text), lambda words: once(F.sort_array(grams(words, 1, most)), lambda terms: _ranked(terms, n)))


def _ranked(terms: Column, n: int) -> Column:
    """The n most frequent of sorted terms: a term's count is the distance from its first place to the next term's."""
    places = F.when(F.size(terms) > 0, F.sequence(F.lit(0), F.size(terms) - 1)).otherwise(F.array().cast("array<int>"))
    firsts = F.filter(places, lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))

    def rank(firsts: Column) -> Column:
        counts = F.transform(firsts, lambda at, k: F.struct((at - F.coalesce(F.get(firsts, k + 1), F.size(terms))).alias("o"), F.get(terms, at).alias("t")))
        return F.transform(F.slice(F.sort_array(counts), 1, n), lambda x: x["t"])

    return once(firsts, rank)


def one_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text; rows of one key, if there are such, are one text with a line for each. Texts are shuffled in that case only."""
    if docs.groupBy(key).count().where("count > 1").isEmpty():
        return docs.select(key, text)
    return docs.groupBy(key).agg(F.concat_ws("\n", F.collect_list(text)).alias(text))


def top_words(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, terms: the n most frequent words of each key that has any, ranked in its text; counts are not shuffled."""
    return one_text(docs, key, text).select(key, keywords(F.col(text), n, 1).alias("terms")).where(F.size("terms") > 0)
