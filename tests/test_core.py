import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vellumflow.functions import text as T
from vellumflow.functions.unicode import canonical_key, casefolded, normal_name
from vellumflow.operators import curation, library, metrics, split, terms, upsert
from vellumflow.operators.claims import violations, with_claims
from vellumflow.operators.features import DATASETS, METHODS, extractor, matched, with_features
from vellumflow.operators.selection import prompt_text
from vellumflow.schemas import PAPERS, STATE
from vellumflow.sources.jsonl import BadLine, read_examples, read_papers
from vellumflow.sources.shards import write_claim_shards
from vellumflow.streaming.ingest import Saturated, Store, fetch, stream


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).head()


def test_ids(spark):
    r = one(spark, a=T.split_version(F.lit("http://arxiv.org/abs/quant-ph/0201082v1")), b=T.split_version(F.lit("2107.05580")), c=T.feed_id(F.lit("http://arxiv.org/abs/quant-ph/0201082v1")))
    assert (r.a.base, r.a.version) == ("quant-ph/0201082", 1)
    assert (r.b.base, r.b.version) == ("2107.05580", 1)
    assert (r.c.versioned, r.c.base) == ("0201082v1", "0201082")


def test_unicode(spark):
    df = spark.createDataFrame([("Ｆréchet  Straße",), (None,)], "s string")
    rows = df.select(normal_name("s").alias("n"), canonical_key("s").alias("k"), casefolded("s").alias("c")).collect()
    assert rows[0].n == "Fréchet Straße" and rows[0].k == "frechet strasse" and rows[0].c.endswith("strasse") and rows[1].n is None


def test_urls(spark):
    text = "https://gist.github.com/x. http://github.com.evil.example/a https://notgithub.com/b https://github.com@evil.com/x https://gitlab.com/c;"
    assert one(spark, u=T.code_urls(F.lit(text))).u == ["https://gist.github.com/x", "https://gitlab.com/c"]


def test_terms_match_longest_first(spark):
    r = one(spark, a=matched(F.lit("Fashion-MNIST results"), DATASETS), b=matched(F.lit("transformers"), METHODS), c=matched(F.lit("a transformer-based one"), METHODS))
    assert (r.a, r.b, r.c) == (["Fashion-MNIST"], [], ["transformer"])


def test_features_skip_related_work(spark):
    row = ("Title", "Prior work used a diffusion model; we use a random forest. Not limited to text. A limitation is cost.", "")
    df = spark.createDataFrame([row, ("T", "", None)], "title string, abstract string, paper_text string")
    rows = [r.features for r in extractor("rules")(df).collect()]
    assert rows[0].methods == ["random forest"] and rows[0].limitations == ["A limitation is cost."]
    assert rows[1].one_sentence_summary == "No abstract available." and rows[1].keywords == []
    with pytest.raises(ValueError):
        extractor("none")


def test_claims(spark):
    text = "We show that A improves accuracy by 3.2% compared with BERT on the ImageNet dataset. Our results indicate no improvement under noise. Prior work: we show x. It remains unclear why."
    df = with_claims(spark.createDataFrame([(text,), ("Nothing here.",), (None,)], "abstract string"))
    rows = df.collect()
    first, second = rows[0].validity_envelopes
    assert (first.claim_type, first.direction, first.comparators, first.reported_values) == ("comparative", "positive", ["BERT"], ["3.2%"])
    assert second.direction == "negative" and second.conditions == ["under noise"] and second.evidence.sentence_index == 1
    assert first.paper_level_boundaries == ["It remains unclear why."] and first.confidence == pytest.approx(0.75)
    assert [r.status for r in rows] == ["extracted", "no_supported_claim", "no_supported_claim"]
    assert violations(df.where("abstract is not null")).count() == 0


def test_upsert_cases(spark):
    t = datetime(2024, 1, 1)
    def row(i, v, at, title, p):
        return dict(arxiv_id=i, versioned_id=f"{i}v{v}", version=v, title=title, updated_at=at, position=p, seen_at=t + timedelta(hours=p))
    schema = f"{PAPERS}, position long, seen_at timestamp"
    empty = spark.createDataFrame([], PAPERS)
    batch = spark.createDataFrame([row("a", 1, t, "one", 1), row("a", 1, t, "two", 2), row("b", 2, t, "b2", 1)], schema)
    first = upsert.upsert(empty, batch)
    rows = {r.arxiv_id: r for r in first.collect()}
    assert rows["a"].title == "one" and rows["a"].last_seen_at == t + timedelta(hours=2) and rows["a"].created_at == t + timedelta(hours=1)
    held = spark.createDataFrame(upsert.set_file(first, "b", "pdf", "/x").collect(), PAPERS)
    again = upsert.upsert(held, spark.createDataFrame([row("b", 2, t, "new", 5)], schema)).where("arxiv_id = 'b'").head()
    assert (again.title, again.pdf_path) == ("b2", "/x")
    older = upsert.upsert(held, spark.createDataFrame([row("b", 1, t, "b1", 5)], schema)).where("arxiv_id = 'b'").head()
    assert (older.version, older.pdf_path, older.created_at) == (1, None, t + timedelta(hours=1))


def test_windows():
    now, mark = datetime(2024, 6, 23, 12), datetime(2024, 6, 20, 12)
    assert upsert.window_start(mark, now) == datetime(2024, 6, 19, 12)
    assert upsert.window_start(None, now) == now - timedelta(hours=24)
    assert upsert.state_key("k", ["b", "a", "a"]) == upsert.state_key("k", ["a", "b"])


def papers(spark, rows):
    return spark.createDataFrame([dict(arxiv_id=i, versioned_id=f"{i}v{v}", version=v, title=i, categories=["cs.LG"], published_at=p, updated_at=u) for i, v, p, u in rows], PAPERS)


def test_fetch_and_stream(spark, tmp_path):
    now = datetime(2024, 6, 23, 12)
    land = papers(spark, [("a", 1, now - timedelta(hours=2), now - timedelta(hours=2)), ("b", 1, now - timedelta(hours=3), now - timedelta(hours=1)), ("c", 2, now - timedelta(days=9), now - timedelta(hours=5))])
    store = Store(spark, str(tmp_path / "store"))
    report = fetch(store, land, ["cs.LG"], now)
    assert (report["inserted"], report["submissions"], report["revisions"]) == (3, 2, 1)
    assert store.state.count() == 2
    assert fetch(store, land, ["cs.LG"], now)["unchanged"] == 3
    other = Store(spark, str(tmp_path / "other"))
    with pytest.raises(Saturated):
        fetch(other, land, ["cs.LG"], now, cap=1)
    assert other.papers.count() == 1 and other.state.count() == 0
    land.write.parquet(str(tmp_path / "landing"))
    third = Store(spark, str(tmp_path / "third"))
    for _ in range(2):
        stream(spark, str(tmp_path / "landing"), third, str(tmp_path / "cp")).awaitTermination()
    assert third.papers.count() == 3


def test_quotas(spark):
    q = {r.category: r.quota for r in curation.quotas(spark.createDataFrame([("cs.LG", 10), ("math.CO", 2)], "category string, n long"), 6).collect()}
    assert q == {"cs.LG": 5, "math.CO": 1}
    with pytest.raises(ValueError):
        curation.quotas(spark.createDataFrame([("a", 3), ("b", 3)], "category string, n long"), 1)


def test_curate_ranks_withdrawn_last(spark):
    rows = [(f"p{i}", "cs.LG", "a title of four words", "withdrawn" if i == 0 else "text " * i, ["cs.LG"], None, None, None) for i in range(6)]
    df = spark.createDataFrame(rows, "versioned_id string, primary_category string, title string, abstract string, categories array<string>, doi string, journal_ref string, comment string")
    kept = {r.versioned_id for r in curation.curate(df, 5).collect()}
    assert len(kept) == 5 and "p0" not in kept


def test_split_sizes(spark):
    df = spark.createDataFrame([("a", 12), ("b", 3), ("c", 30), ("d", 6)], "label string, n long")
    got = {r.label: (r.test, r.validation, r.train) for r in split.split_sizes(df, "label").collect()}
    assert got == {"a": (2, 2, 8), "b": (1, 1, 1), "c": (4, 4, 22), "d": (1, 1, 4)}
    with pytest.raises(ValueError):
        split.split_sizes(spark.createDataFrame([("a", 2)], "label string, n long"), "label")


def test_set_metrics(spark):
    s = lambda *x: spark.createDataFrame([(v,) for v in x], "v string")
    r = metrics.set_metrics(s("a", "b"), s("b", "c"), ["v"]).head()
    assert (r.true_positives, r.precision, r.recall, r.f1) == (1, 0.5, 0.5, 0.5)
    r = metrics.set_metrics(s(), s(), ["v"]).head()
    assert (r.precision, r.recall, r.f1) == (1, 1, 1)
    r = metrics.set_metrics(s(), s("a"), ["v"]).head()
    assert (r.precision, r.recall, r.f1) == (0, 1, 0)


def test_calibration(spark):
    df = spark.createDataFrame([(0.1, True), (0.95, True), (0.95, False)], "c double, ok boolean")
    assert metrics.calibration_error(df, "c", "ok").head()[0] == pytest.approx(0.6)
    assert [r.accuracy for r in metrics.selective(df, "c", "ok").collect()] == [0.5, 0.5, 0.5]


def test_evidence_coverage(spark):
    df = with_features(spark.createDataFrame([("MNIST", "We report accuracy.", "")], "title string, abstract string, paper_text string"))
    assert df.select(metrics.evidence_coverage(F.col("features"))).head()[0] == 1.0


def test_prompt(spark):
    body = "intro\n1 METHODS\n" + "m " * 300 + "\nRESULTS\n" + "r " * 300
    df = spark.createDataFrame([("T", "A", body), ("T", "A", "x" * 5000), ("T", "A", None)], "title string, abstract string, full_text string")
    out = [r.prompt for r in prompt_text(df, 350).collect()]
    assert "METHODS" in out[0] and "RESULTS" in out[0] and "intro" not in out[0] and max(map(len, out)) <= 350
    assert "middle omitted" in out[1] and len(out[1]) == 350 and out[2].endswith("A\n")


def test_keywords(spark):
    assert one(spark, k=terms.keywords(F.lit("beta alpha beta the beta alpha"))).k[:3] == ["beta", "alpha", "beta alpha"]


def test_search_limits_before_it_filters(spark):
    rows = [(str(i), "t", "needle" if i < 3 else "", [], ["c"], i) for i in range(10)]
    df = spark.createDataFrame(rows, "arxiv_id string, title string, abstract string, authors array<string>, categories array<string>, published_at int")
    assert library.search(df, "needle", first=9).count() == 2
    assert library.clamp_limit("9999") == 500
    with pytest.raises(ValueError):
        library.clamp_limit("x")


def write_jsonl(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def paper(i, day="2024-01-01", abstract="We show that it improves accuracy by 5%."):
    return {"arxiv_id": str(i), "versioned_id": f"{i}v1", "submitted_date": day, "title": "t", "abstract": abstract}


@pytest.mark.parametrize("bad", ["", "[1]", "{", json.dumps(paper(1)), json.dumps(paper(3, "2024-1-3")), json.dumps(paper(3) | {"title": " "})])
def test_strict_lines(spark, tmp_path, bad):
    with pytest.raises(BadLine, match="line 2"):
        read_papers(spark, write_jsonl(tmp_path / "x.jsonl", [paper(1), bad, paper(9)]))


def test_examples_skip_blank_lines(spark, tmp_path):
    rows = [{"title": "a", "abstract": "b", "primary_category": "c"}, "", {"arxiv_id": "7", "title": "a", "abstract": "b", "primary_category": "c"}]
    assert sorted(r.arxiv_id for r in read_examples(spark, write_jsonl(tmp_path / "x.jsonl", rows)).collect()) == ["7", "line-1"]


def test_claim_shards(spark, tmp_path):
    source = write_jsonl(tmp_path / "x.jsonl", [paper(1), paper(2, "2024-01-02", "No."), paper(3)])
    target = tmp_path / "out"
    m = write_claim_shards(spark, source, str(target), 3)
    assert (m["paper_count"], m["papers_with_envelopes"], m["envelope_count"]) == (3, 2, 2)
    assert [s["paper_count"] for s in m["shards"]] == [2, 1]
    data = (target / "2024-01-01.jsonl").read_bytes()
    assert hashlib.sha256(data).hexdigest() == m["shards"][0]["sha256"] and [json.loads(x)["arxiv_id"] for x in data.splitlines()] == ["1", "3"]
    with pytest.raises(ValueError):
        write_claim_shards(spark, source, str(target), 4)
    assert (target / "2024-01-01.jsonl").read_bytes() == data


def test_state_rows(spark):
    state = spark.createDataFrame([("a", datetime(2024, 1, 1), datetime(2024, 1, 1))], STATE)
    now = datetime(2024, 2, 1)
    assert {r.state_key: r.state_value for r in upsert.advance(state, {"a": now, "b": now}, now).collect()} == {"a": now, "b": now}
