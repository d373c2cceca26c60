"""Terms as spans against plain Python: many aliases in several parts, folding, borders, evidence."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vellumflow.operators import spans
from vellumflow.operators.claims import claim_spans, claims
from vellumflow.functions.text import distinct_folded, squeeze


def brute(text, aliases):
    """(vocabulary, label, start, end) by all matches of all aliases, longest first, then from the left."""
    out = []
    for name in sorted({a[0] for a in aliases}):
        best = {}
        for v, label, place, alias in aliases:
            if v == name and alias and (alias not in best or (place, label) < best[alias]):
                best[alias] = (place, label)
        found = [(m.start(1), m.end(1), label) for alias, (_, label) in best.items() for m in re.finditer(rf"(?<!\w)(?=({re.escape(alias.lower())})(?!\w))", text.lower())]
        taken = []
        for a, b, label in sorted(found, key=lambda f: (f[0] - f[1], f[0])):
            if all(b <= c or d <= a for c, d, _ in taken):
                taken.append((a, b, label))
        out += [(name, label, a, b) for a, b, label in taken]
    return sorted(out)


@pytest.mark.parametrize("part", [spans.PART_CHARS, 40])
def test_terms_by_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(spans, "PART_CHARS", part)
    rng = random.Random(4)
    words = ["a", "ab", "b", "b-c", "c", "é", "x_y", "1"]
    pick = lambda n: " ".join(rng.choice(words) for _ in range(n))
    aliases = [(rng.choice(["v", "w"]), f"l{i}", i, pick(rng.randint(1, 4))) for i in range(60)] + [("v", "none", 99, "")]
    texts = [pick(rng.randint(0, 40)) for _ in range(60)] + ["A B-C. ab,b;É x_y 1a 1", "", None, "a" * 10_000 + " b " * 3000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "i int, text string, label int")
    table = spark.createDataFrame(aliases, "vocabulary string, label string, place int, alias string")
    got = {r.i: sorted((x.vocabulary, x.label, x.start, x.end) for x in r.terms) for r in spans.with_terms(df, table).collect()}
    assert got == {i: brute(t or "", aliases) for i, t in enumerate(texts)}
    # No alias, no terms.
    assert spans.with_terms(df, table.limit(0)).where("size(terms) > 0").count() == 0


def test_folding_keeps_positions(spark):
    table = spark.createDataFrame([("v", "street", 0, "STRASSE"), ("v", "half", 1, "s"), ("v", "dot", 2, "i̇x")], "vocabulary string, label string, place int, alias string")
    df = spark.createDataFrame([(1, "Die Straße und STRASSE"), (2, "ß s"), (3, "İX"), (4, "ﬁ strasse")], "i int, text string")
    got = {r.i: [(x.label, x.start, x.end) for x in r.terms] for r in spans.with_terms(df, table).collect()}
    assert got == {1: [("street", 4, 10), ("street", 15, 22)], 2: [("half", 2, 3)], 3: [("dot", 0, 2)], 4: [("street", 2, 9)]}


def test_longest_first_and_within():
    assert spans.longest_first([(0, 3, "a"), (2, 8, "b"), (7, 9, "c"), (8, 9, "d")]) == [(2, 8, "b"), (8, 9, "d")]
    assert spans.within([(0, 2), (3, 5), (4, 9), (11, 12)], [(0, 5), (6, 10), (11, 12)]) == {0: [(0, 2), (3, 5)], 2: [(11, 12)]}
    text = "One; two. Three, but four!  Five"
    assert [text[a:b] for a, b in spans.sentence_spans(text)] == ["One; two.", "Three, but four!", "Five"]
    assert [text[a:b] for a, b in spans.clause_spans(text)] == ["One", " two.", "Three", "four!", "Five"]


def test_evidence_of_own_clauses(spark):
    table = spark.createDataFrame([("use", "Net", 0, "net"), ("use", "Tree", 1, "tree"), ("all", "Net", 0, "net"), ("all", "Map", 1, "map")], "vocabulary string, label string, place int, alias string")
    rows = [(1, "A  tree", "Related work has a net; a map.\nWe  use a tree. It is a net."), (2, None, "Prior work: a net."), (3, "a net", None)]
    df = spark.createDataFrame(rows, "i int, t string, b string")
    got = {r.i: sorted((x.vocabulary, x.label, x.start, x.end, x.statement) for x in r.x) for r in spans.with_feature_terms(df, table, ["use"], "t", "b", "x").collect()}
    whole, clean = "\n".join(rows[0][1:]), "Related work has a net; a map.\nWe use a tree. It is a net."
    at = lambda text, word, first=True: (i := text.index(word) if first else text.rindex(word), i + len(word))
    said = "Related work has a net; a map."
    assert got[1] == sorted(
        [
            ("all", "Map", *at(whole, "map"), said),
            ("all", "Net", *at(whole, "net"), said),
            ("all", "Net", *at(whole, "net", False), None),
            ("use", "Net", *at(clean, "net", False), "It is a net."),
            ("use", "Tree", 3, 7, "A tree"),
            ("use", "Tree", *at(clean, "tree"), None),
        ]
    )
    assert got[2] == [("all", "Net", 15, 18, "Prior work: a net.")]
    assert got[3] == [("all", "Net", 2, 5, "a net"), ("use", "Net", 2, 5, "a net")]


def test_claims_and_distinct_values_of_long_texts(spark):
    """Ten thousand statements in one text: neighbours are compared, not all pairs."""
    text = " ".join(f"We find that point {i % 4000} holds." for i in range(10_000))
    df = spark.createDataFrame([(1, text, [f"V{i % 3000}" if i % 2 else f"v{i % 3000}" for i in range(20_000)])], "i int, t string, v array<string>")
    r = df.select(distinct_folded(F.col("v")).alias("d"), claims(squeeze("t")).alias("c")).collect()[0]
    assert len(r.d) == 3000 and r.d[:3] == ["v0", "V1", "v2"]
    assert [(c.sentence_index, c.claim, c.start) for c in r.c] == [(i, f"We find that point {i} holds.", i * 28) for i in range(5)]


def test_claim_places(spark):
    text = "  Some  words. However  we find   that heat helps (p < 0.01), whereas our model improves recall on MNIST. "
    rows = claim_spans(spark.createDataFrame([(1, text), (2, None), (3, "Nothing.")], "i int, abstract string"), "i").collect()
    clean = " ".join(text.split())
    assert all(clean[r.start : r.end] == r.value for r in rows) and {r.i for r in rows} == {1}
    assert {(r.claim_index, r.kind, r.value) for r in rows} >= {(0, "claim", "However we find that heat helps (p < 0.01)"), (0, "uncertainty", "p < 0.01"), (1, "claim", "our model improves recall on MNIST."), (1, "metrics", "recall"), (1, "evaluation_contexts", "MNIST")}


def test_candidates_stay_in_the_task(spark):
    """One pass of Python gives the chosen terms; rows of several slices and texts without terms keep their places."""
    table = spark.createDataFrame([("v", "net", 0, "net")], "vocabulary string, label string, place int, alias string")
    df = spark.createDataFrame([(i, "a net, net" if i % 3 else None, "net") for i in range(2 * spans.SLICE_ROWS + 5)], "i int, text string, t string").coalesce(1)
    for out, least in ((spans.with_terms(df, table, out="x"), 2), (spans.with_feature_terms(df, table, ["v"], "t", "text", "x"), 1)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
        sizes = {r.i: len(r.x) for r in out.collect()}
        assert len(sizes) == df.count() and all((n >= least) == (i % 3 > 0 or least == 1) for i, n in sizes.items())
