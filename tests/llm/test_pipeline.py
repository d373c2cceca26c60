"""Each stage of the pipeline on its own input, and the SQL of queries that have some."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from vellumflow.llm import line_dedup, near_dedup, packing, quality, queries, secret_scan

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(P.STAGES[:-1]):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == P.COLUMNS
        out.write.parquet(str(tmp_path / str(i)))
        after_df = spark.read.parquet(str(tmp_path / str(i)))
        after = {r.doc_id: r for r in after_df.collect()}
        if name == "quality_rules":
            assert set(after) == {r.doc_id for r in quality.judge(docs).where("kept").collect()}
            assert all(after[k] == before[k] for k in after)
        elif name == "line_dedup":
            assert {k: r.text for k, r in after.items()} == {r.doc_id: r.kept_text for r in line_dedup.drop_common_lines(docs).collect()}
        elif name == "minhash_near_dedup":
            assert set(after) == {r.doc_id for r in near_dedup.near_duplicates(docs).where("kept").collect()}
        else:
            want = secret_scan.find_secrets(docs).select("doc_id", secret_scan.masked("text", "spans").alias("t"))
            assert {k: r.text for k, r in after.items()} == {r.doc_id: r.t for r in want.collect()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        docs = after_df
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.agg(F.sum("length")).head()[0] == packing.cut(docs).agg(F.sum("length")).head()[0]


def test_near_dedup_links_by_four_words(spark):
    from test_operators import brute_components

    # One of 43 words changed: 36 of 44 shingles of four words are shared, 34 of 44 of five. Of 60 words both sizes link.
    texts = {}
    for i, n in enumerate((43, 60, 43, 60)):
        words = [f"w{i}x{j}" for j in range(n)]
        texts[2 * i], texts[2 * i + 1] = " ".join(words), " ".join([*words[:20], "other", *words[21:]])
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    four, five = ({i for i, (_, root) in brute_components(texts, n).items() if i == root} for n in (4, 5))
    assert four != five
    assert {r.doc_id for r in P.near_dedup(spark, df, SF).collect()} == four


def test_stages_take_odd_rows(spark, odd, empty):
    # Short and repetitive texts fail the base rules; no other stage drops a row of these.
    all_ids = sorted(str(r.doc_id) for r in odd.collect())
    df = odd.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in P.STAGES:
        got = sorted(str(r.doc_id) for r in stage(spark, df.select(*P.COLUMNS), SF).where("piece = 0" if name == "best_fit_packing" else "true").collect())
        assert got == ([] if name == "quality_rules" else all_ids)
    kept = P.secret_scan(spark, odd.withColumn("n_chars", F.lit(0).cast("long")).select(*P.COLUMNS), SF)
    assert kept.where("text is null").count() == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = con.execute(queries.ORACLE[name])
    names = [d[0] for d in got.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    rows = [tuple(r[names.index(c)] for c in columns) for r in got.fetchall()]
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(rows, key=repr)


def brute_line_dedup(texts):
    from test_operators import key_of

    held = {}
    for i, t in texts.items():
        for line in t.split("\n"):
            if len(key_of(line)) >= 40:
                held.setdefault(key_of(line), set()).add(i)
    gone = lambda i, line: len(held.get(key_of(line), ())) >= 5 and max(held[key_of(line)]) != i
    return {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in texts.items()}


def test_stages_by_brute_force(spark):
    """Each stage on its own small table, against code of its own, with columns whose names operators use inside."""
    import collections

    import numpy as np
    from test_operators import brute_components, spans_of, stats_of

    rng = np.random.default_rng(21)
    words = ["river", "stone", "under", "light", "green", "table", "often", "seven"]
    words += [a + b for a in words for b in ("s", "ed", "ing", "ly")]
    said = lambda n: " ".join(rng.choice(words, n))
    common = "this line stands in many of the documents here, word for word"

    def table(texts):
        rows = [(i, t, "en", "s", len(t) if t is not None else None, "x", 1, "y") for i, t in texts.items()]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _d string, c int, kept string")

    def result(stage, texts):
        out = stage(spark, table(texts), SF)
        assert out.columns == P.COLUMNS
        rows = out.collect()
        assert all(r.n_chars == (len(r.text) if r.text is not None else None) and (r.lang, r.source) == ("en", "s") for r in rows)
        assert len({r.doc_id for r in rows}) == len(rows)
        return {r.doc_id: r.text for r in rows}

    # Base rules; all others are plain prose but for three texts far outside.
    texts = {i: said(int(rng.integers(60, 200))) for i in range(80)} | {100: said(10), 101: said(8) + " " + said(9) * 9, 102: "", 103: None}
    texts |= {200 + i: " ".join(w + "#&$" for w in rng.choice(words, 90)) for i in range(3)}
    base = {i for i, t in texts.items() if not (stats_of(t or "")[0] < 20 or 100 * stats_of(t or "")[4] > 30 * stats_of(t or "")[0])}
    assert result(P.quality_rules, texts) == {i: texts[i] for i in base if i < 200}

    texts = {i: f"own {i}\n {common if i % 2 else common.upper()}\t\nend" for i in range(7)} | {10: None, 11: "", 12: f"{common}\n{common}"}
    want = brute_line_dedup({i: t or "" for i, t in texts.items()})
    assert result(P.line_dedup, texts) == {i: want[i] if texts[i] is not None else None for i in texts}

    first = said(120).split()
    texts = {i: " ".join(first[:40] + [f"new{i}"] + first[41:]) for i in range(6)} | {20: said(100), 21: said(100), 30: None, 31: "", 32: "a b", 33: "A  b"}
    roots = brute_components({i: t or "" for i, t in texts.items()})
    assert result(P.near_dedup, texts) == {i: texts[i] for i in texts if roots[i][1] == i}

    texts = {i: f"{said(5)} token=abc{i}def0123 {said(3)} {'0a1b' * 8} {said(3)} AKIA{'QW12' * 5} end" for i in range(5)} | {10: "nothing here", 11: None, 12: ""}

    def masked(t):
        out, at = "", 0
        for low, high in sorted((a, b) for a, _, b in spans_of(t)):
            out, at = out + (t[at:low] + secret_scan.MASK if low > at or not at else ""), max(at, high)
        return out + t[at:]

    assert result(P.secret_scan, texts) == {i: t if t is None else masked(t) for i, t in texts.items()}

    texts = {i: said(int(rng.integers(1, 3000))) for i in range(30)} | {40: None, 41: ""}
    pieces = P.best_fit_packing(spark, table(texts), SF).collect()
    own = collections.defaultdict(int)
    for p in pieces:
        own[p.doc_id] += p.length
    path = packing.vocabulary_path()
    assert own == {i: len(packing._slow(path).encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert len({p.sequence_id for p in pieces}) == packing.lower_bound(collections.Counter(p.length for p in pieces), 2048)


def test_stages_on_no_rows(spark, empty):
    for name, stage in P.STAGES:
        out = stage(spark, empty.withColumn("n_chars", F.lit(0).cast("long")), SF)
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == P.COLUMNS)


def test_scratch_tables_go(spark):
    from vellumflow.llm.common import Scratch, passing

    with passing():
        kept = Scratch(spark)
        kept.store(spark.range(3).toDF("k"), "a")
        kept.store_sorted(spark.range(3).toDF("k"), "b", ["k"])
        names = {t.name for t in spark.catalog.listTables()}
        assert any(kept.run in n for n in names)
    assert not any(kept.run in t.name for t in spark.catalog.listTables())
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{kept.path}/a").count()
