"""Every query against its SQL on the smallest tables."""

import collections
import re

import duckdb
import fixed_rows  # noqa: F401  (it registers its cases)
import pytest
import run_cases  # noqa: F401
from given import CASES, RESULTS

from vellumflow.operators import claims, terms
from vellumflow.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def compared(df, got):
    columns = sorted(df.columns)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert canon(map(tuple, df.select(*columns).collect())) == canon(tuple(r[i] for i in places) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    compared(QUERIES[name](spark, SF), con.execute(ORACLE[name]))


@pytest.mark.parametrize("name", sorted(CASES))
def test_fixed_rows(spark, con, name):
    compared(CASES[name](spark, SF), con.execute(RESULTS[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def brute_claims(text):
    """Distinct claims of a text, by Python's patterns."""
    py = lambda p: p.replace("(?iU)", "(?i)")
    out = []
    for sentence in re.split(r"(?<=[.!?])(?:\s+|(?=[A-Z]))", " ".join(text.split())):
        whole = re.search(r"(?i)\bnot only\b.+\bbut (?:also|even)\b", sentence)
        for c in [sentence] if whole else re.split(r"(?i)(?:[;\n]+|\s*,?\s+\b(?:but|however|whereas)\b\s*)", sentence):
            c = c.strip()
            if c and not re.search(py(claims.RELATED), c) and re.search(py(claims.CLAIM), c) and c.lower() not in out:
                out.append(c.lower())
    return out[: claims.MOST_ENVELOPES]


def test_claims_of_whole_texts(spark, tmp_path):
    rows = [
        (1, "First words. We find that heat helps. It is late; our results show less noise, but we show more. we find that heat helps.", "en", "a"),
        (2, "Nothing here. " * 50 + "Prior work and we find it. Our model improves recall.", "en", "a"),
        (3, "We find. We show. We report. We confirm. We achieve. We observe.", "en", "b"),
        (4, "Premier. We find that heat helps.", "fr", "b"),
        (5, "Rien.", "fr", "b"),
    ]
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").where("text is not null")
    df = given.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for r in df.collect():
        n = len(brute_claims((f"We show that accuracy improves by {r.doc_id}% on ImageNet. " if r.lang == "en" else "") + r.text))
        papers, some, every = want.get(r.source, (0, 0, 0))
        want[r.source] = (papers + 1, some + (n > 0), every + n)
    got = {r.source: (r.paper_count, r.with_envelopes, r.envelopes) for r in QUERIES["claim_status"](spark, str(tmp_path)).collect()}
    assert got == want and got["a"] == (2, 2, 6) and got["b"] == (3, 2, 6)


def test_prompts_of_all_documents(spark, tmp_path):
    rows = [(1, "word " * 500, "en", "a"), (2, "word " * 2000, "en", "a"), (3, None, "en", "a"), (4, "Short. Text.", "en", None), (5, "", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.length for r in QUERIES["prompts"](spark, str(tmp_path)).collect()}
    empty = len("TITLE\n\n\nABSTRACT\n\n")
    whole = len("\nFULL PAPER TEXT\n")
    assert got == {1: empty + 1 + 240 + whole + 2500, 2: 4000, 3: empty + 1, 4: empty + 12 + whole + 12, 5: empty + 1}


def brute_keywords(text):
    words = [w for w in re.findall(r"\b\w\w+\b", text.lower()) if w not in terms.STOP_WORDS]
    counts = collections.Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])
    return "|".join(sorted(counts, key=lambda t: (-counts[t], t.encode()))[:12])


def test_keywords_of_documents(spark, tmp_path):
    rows = [(10**6, "the of"), (10**6 + 1, None), (10**6 + 2, "beta Beta alpha " * 3000), (10**6 + 3, " ".join(f"w{i % 701}" for i in range(20_000))), (10**6 + 4, "one")]
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    df = given.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.terms for r in QUERIES["keywords"](spark, str(tmp_path)).collect()}
    assert got == {r.doc_id: brute_keywords(r.text or "") for r in df.collect()}
