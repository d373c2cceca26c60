"""Words and letters of one read of each text, against the expressions and against a count of all terms."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vellumflow.functions.text import without_accents
from vellumflow.operators import classifier, hashed, net, scanned, split, terms

ODD = ["Café NAÏVE\tcafé ẞß straße", "the a an x y", "", None, "ab́c d‍e ⓐⓑ Ⅷⅷ x_y 12 3", "𝒳𝒴 𐐀𐐨　世界 ﻿bom﻿ zero", "İI ΣΑΣ ος \x00nul\x1fsep\x85nel", "ab " * 5000 + "Ω"]


def told(texts, name, characters):
    out = []
    for both in scanned.slices(pa.array(texts), characters):
        laid = both[name]
        out += [(laid.term(int(at), n), int(h)) for n in scanned.SIZES[name] for at, h in zip(*laid.of(n), strict=True)]
    return out


def test_layouts_are_those_of_expressions(spark, monkeypatch):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    characters = scanned.Characters.asked(spark)
    texts = [r.t for r in df.select(scanned.lowered("t").alias("t")).collect()]
    words = [r.w for r in df.select(terms.tokens(without_accents(F.lower(F.coalesce("t", F.lit(""))))).alias("w")).collect()]
    grams = [g for some in words for g in [*some, *(f"{a} {b}" for a, b in zip(some, some[1:], strict=False))]]
    letters = [laid.term(int(at), n) for laid in hashed.Terms(hashed.Letters, None, 3, 5).slices(pa.array(texts)) for n in (3, 4, 5) for at in laid.of(n)[0]]
    for room in (hashed.SLICE_BYTES, 10):
        monkeypatch.setattr(hashed, "SLICE_BYTES", room)
        for name, want in (("w", grams), ("c", letters)):
            got = told(texts, name, characters)
            assert sorted(t for t, _ in got) == sorted(want)
            assert all(scanned.KINDS[name].hash_of(t) == h for t, h in set(got)) and len(set(got)) == len(set(want))


def test_every_character_as_in_tokens(spark):
    """Words of two letters between blanks, for all code points at once."""
    characters = scanned.Characters.asked(spark)
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([("".join(f"b{chr(i)}{chr(i)} " for i in points[a : a + 4096]),) for a in range(0, len(points), 4096)], "t string")
    rows = df.select(F.lower("t").alias("t"), terms.tokens(without_accents(F.lower("t"))).alias("w")).collect()
    for r in rows:
        got = [both["w"].term(i, 1) for both in scanned.slices(pa.array([r.t]), characters) for i in range(len(both["w"].codes))]
        assert got == r.w


def test_vocabulary_of_a_bad_guess(spark, monkeypatch):
    """Terms that the guess misses are found all the same; those that it has are counted over all rows."""
    texts = [f"common{i % 3} rare{i} seldom{i % 40}" for i in range(200)] + ["late late late late late early"] * 100
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    kinds, sizes = classifier._blocks(), {"w": 6, "c": 5}
    want = {b: sorted((r.term, r.df) for r in hashed.vocabulary(df, "text", kinds[b], sizes[b], 2, 299).collect()) for b in kinds}
    assert scanned.vocabulary(df, "text", kinds, sizes, 300, 2, 299) == want
    full, asked = hashed.vocabulary, []

    def misled(docs, text, terms_, size, *bounds):
        asked.append(size)
        found = full(docs, text, terms_, size, *bounds)
        return found.where("term not like '%late%'") if len(asked) <= 2 else found

    monkeypatch.setattr(hashed, "vocabulary", misled)
    assert scanned.vocabulary(df, "text", kinds, sizes, 300, 2, 299) == want and len(asked) > 2
    monkeypatch.setattr(hashed, "vocabulary", full)
    monkeypatch.setattr(scanned, "GUESS_TEXTS", 30)
    assert scanned.vocabulary(df, "text", kinds, sizes, 300, 2, 299) == want


def test_borders_are_those_of_ordering_all_rows(spark):
    """Also of keys that are there more than once; and no row is shuffled to be told its part."""
    df = spark.createDataFrame([(i, "abc"[i % 7 % 3], f"text {i}") for i in range(900)], "id int, label string, text string")
    told, n = split.borders(df, "id", "label", 0.2, 0.15, 5)
    got = split.within(df, "id", "label", told, 5)
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    want = split.stratified(df, "id", "label", 0.2, 0.15, 5)
    assert sorted(got.collect()) == sorted(want.collect()) and got.where("split = 'train'").count() == n
    assert split.borders(spark.createDataFrame([(1, "a")] * 9, "id int, label string"), "id", "label") is None
    assert split.borders(spark.createDataFrame([(None, "a")] * 9, "id int, label string"), "id", "label") is None


def test_training_holds_no_texts(spark):
    """Vectors are made of texts that are neither shuffled nor held in memory."""
    papers = spark.createDataFrame([(str(i), "", f"robot arm {i % 5}" if i % 2 else f"protein cell {i % 3}", str(i % 2)) for i in range(60)], "arxiv_id string, title string, abstract string, primary_category string")
    run = classifier.train_and_evaluate(papers, features=20, model=classifier.LOGISTIC, iterations=(2,))
    plan = run.split._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and "Exchange" not in plan and run.metrics["accuracy"] == 1.0


def test_blocks_are_small_and_made_of_arrow_lists(spark):
    index, value = pa.array([[9], [1, 2], None, [], [3]], pa.list_(pa.int32())).slice(1), pa.array([[9.0], [1.0, 2.0], None, [], [3.0]]).slice(1)
    got = net.Sparse.of_lists(index, value, 4)
    assert got.dense(np.arange(4)).tolist() == net.Sparse(index.to_pylist(), value.to_pylist(), 4).dense(np.arange(4)).tolist() == [[0, 1, 2, 0], [0] * 4, [0] * 4, [0, 0, 0, 3]]
    rows = spark.range(5000).coalesce(1).selectExpr("id", "struct(array(cast(id % 3 as int)) as index, array(double(id)) as value) as features", "0 as y")
    told = net.spread(rows, "id", 3, 1).rdd.map(lambda b: (len(b.x), float(b.x.value.sum()))).collect()
    assert sorted(n for n, _ in told) == [0, 904, 2048, 2048] and sum(x for _, x in told) == 5000 * 4999 / 2
