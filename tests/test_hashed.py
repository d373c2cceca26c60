"""TF-IDF by hashes against plain Python; no term is shuffled with its row."""

import collections
import math
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumflow.operators import hashed, terms
from vellumflow.operators.classifier import Vocabulary

TEXTS = ["Ab ab cd the", "ab cd cd  ef\nab", "É ßß x_y ab cd", "", None, "ab " * 300 + "ef gh", "𝒳𝒴𝒵 cd ab"]


def letters(text):
    return [w[i : i + n] for w in (f" {x} " for x in text.lower().split()) for n in (3, 4, 5) for i in range(len(w) - n + 1)]


def words(text):
    some = [w for w in re.findall(r"\b\w\w+\b", text.lower()) if w not in terms.STOP_WORDS]
    return some + [f"{a} {b}" for a, b in zip(some, some[1:], strict=False)]


def brute(texts, terms_of, size, min_df, max_df):
    counts = {k: collections.Counter(terms_of(t)) for k, t in texts.items()}
    df, cf = (collections.Counter(t for c in counts.values() for t in f(c)) for f in (set, collections.Counter.elements))
    chosen = sorted((t for t in df if min_df <= df[t] <= max_df), key=lambda t: (-cf[t], t))[:size]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in chosen}
    out = {}
    for k, c in counts.items():
        raw = {t: (1 + math.log(c[t])) * idf[t] for t in chosen if c[t]}
        length = math.sqrt(sum(x * x for x in raw.values()))
        out |= {(k, t): round(x / length, 9) for t, x in raw.items()}
    return out


@pytest.mark.parametrize("kind,terms_of,size", [(hashed.letter_runs(), letters, 12), (hashed.word_runs(1, 2), words, 5)])
def test_weights_by_brute_force(spark, kind, terms_of, size):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string").repartition(3)
    got = {(r.k, r.term): round(r.weight, 9) for r in hashed.tfidf(df, "k", "t", kind, size, 2, 0.9).collect()}
    assert got == brute({k: t or "" for k, t in enumerate(TEXTS)}, terms_of, size, 2, 0.9 * len(TEXTS))


def test_slices_hold_all_terms(monkeypatch):
    texts = pa.array([(t or "").lower() for t in TEXTS])
    told = lambda: sorted(laid.term(int(at), n) for laid in hashed.Terms(hashed.Letters, None, 3, 5).slices(texts) for n in (3, 4, 5) for at in laid.of(n)[0])
    whole = told()
    monkeypatch.setattr(hashed, "SLICE_BYTES", 10)
    assert told() == whole == sorted(x for t in TEXTS for x in letters(t or ""))


def test_rows_of_one_key_are_one_text(spark):
    df = spark.createDataFrame([(1, "ab cd"), (1, "ab ef"), (None, "cd"), (None, "cd ab"), (2, None), (3, "the")], "k int, t string")
    assert {r.k: r.terms for r in terms.top_words(df, "k", "t", 2).collect()} == {1: ["ab", "cd"], None: ["cd", "ab"]}


def test_vectors_and_top_words_shuffle_no_terms(spark):
    df = spark.createDataFrame([(str(i), f"word{i % 7} other{i % 3} same", "en") for i in range(40)], "arxiv_id string, text string, label string")
    vocabulary = Vocabulary.fit(df, 20)
    made = vocabulary.transform(df)
    plans = [made, terms.top_words(df, "arxiv_id", "text", 3)]
    assert all("Exchange" not in p._jdf.queryExecution().executedPlan().toString() for p in plans)
    names = {r.number: (r.block, r.term) for r in vocabulary.terms.collect()}
    for r in made.where(F.col("arxiv_id").isin("0", "5")).collect():
        assert list(r.features["index"]) == sorted(r.features["index"]) and "same" not in {names[i][1] for i in r.features["index"]}
        assert {names[i][1] for i in r.features["index"] if names[i][0] == "w"} <= set(words(r.text))
        assert {names[i][1] for i in r.features["index"] if names[i][0] == "c"} <= set(letters(r.text))
