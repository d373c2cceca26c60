"""Collocations against counts of all phrases, by plain Python."""

import collections
import re

import numpy as np
import pytest

from vellumflow.llm import collocations

UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, longest=5, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            w = tuple(re.findall("[^ \t]+", piece))
            n[lang] += len(w)
            f.update((lang, w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    often = {k: v for k, v in f.items() if v >= least}
    inner = {(lang, part, v) for (lang, p), v in often.items() if len(p) > 2 for part in (p[1:], p[:-1])}
    # Any longer phrase counts, not only those of one word more.
    for (lang, p), v in often.items():
        inner |= {(lang, p[i : i + m], v) for m in range(2, len(p)) for i in range(len(p) - m + 1)}
    out = collections.defaultdict(list)
    for (lang, p), a in often.items():
        if len(p) < 2 or (lang, p, a) in inner:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out[lang].append((score, a, " ".join(p), left, right))
    rows = []
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        rows += [(lang, i + 1, p, a, left, r, n[lang], s) for i, (s, a, p, left, r) in enumerate(found[:top])]
    return sorted(rows)


def mined(df, **options):
    return sorted(tuple(r) for r in collocations.mine(df, **options).select(*COLUMNS).collect())


ODD = [
    ("a a a a a a. A a b c d e f; a b c d e f", "en"),
    ("one two. three, one two\nthree four five six seven", "en"),
    ("one\ttwo  three four five six seven! one two", "en"),
    (None, "en"),
    ("", None),
    (" \t\n.,;", ""),
    ("Ünï ÜNÏ çödé 日本 語 日本 語, 日本 語", None),
    ("x " * 5000 + "y", "de"),
    ("w" * 50_000 + " b " + "w" * 50_000 + " b", "de"),
    ("one two three four", ""),
    ("one two three four", ""),
]


@pytest.mark.parametrize("hot", [collocations.HOT, 1])
def test_phrases_by_brute_force(spark, monkeypatch, hot):
    given = [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = ODD + given
    # The names are those of columns inside.
    df = spark.createDataFrame([(*r, 0, "p", 1) for r in rows], "text string, lang string, g long, k string, f int").repartition(5)
    # With hot at 1 every prefix of several pointers is split.
    monkeypatch.setattr(collocations, "SHARE", 2 if hot > 1 else 10**9)
    for least, options in ((2, {"top": 50}), (20, {})):
        want = brute(rows, least, **options)
        assert mined(df, least=least, hot=hot, **options) == want
        assert len(want) > 20


def test_bitmaps_only_save_work(spark):
    df = spark.createDataFrame(ODD, "text string, lang string")
    assert mined(df, least=2, slots=1 << 15) == mined(df, least=2) == brute(ODD, 2)
    assert mined(df, least=2, longest=2) == brute(ODD, 2, 2)


def test_large_products(spark):
    """1000 * a * n passes 64 bits."""
    rows = [("p q", "en", 3 * 10**9), ("q p q", "en", 10**9 + 7)]
    f = {"p q": 4 * 10**9 + 7, "q p": 10**9 + 7, "q p q": 10**9 + 7, "p": 4 * 10**9 + 7, "q": 3 * 10**9 + 2 * (10**9 + 7)}
    n = sum(len(t.split()) * c for t, _, c in rows)
    best = 1000 * f["p q"] * n // (f["p"] * f["q"])
    assert 1000 * f["p q"] * n > 2**63
    df = spark.createDataFrame([(f["p q"], n, f["p"], f["q"])], "f long, n long, l long, r long")
    assert df.select(collocations.ratio().alias("x")).collect()[0].x == best


def test_growth_is_depth_first():
    rows = np.array([[1, 2, 3], [1, 2, 4], [1, 5, 0], [2, 2, 2]])
    counts = np.array([2, 1, 3, 1])
    assert list(collocations.grown(rows, counts, 2, 1)) == [(0, 1, 6), (0, 2, 3), (0, 3, 2), (2, 2, 3)]


def test_no_rows(spark, odd, empty):
    assert collocations.mine(empty, least=1).count() == 0
    assert collocations.mine(odd.where("doc_id = 3"), least=1).count() == 0
