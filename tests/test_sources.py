"""Feeds, lines, shards, the swap of folders, saved models and the command line, on files."""

import hashlib
import json

import pytest
from fixed_rows import ENTRIES
from pyspark.sql import functions as F

from vellumflow import __main__ as command
from vellumflow.operators import classifier, features
from vellumflow.sources import feed, jsonl, shards
from vellumflow.sources.swap import Files, recover, replace_directory

FEED = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom" xmlns:opensearch="http://a9.com/-/spec/opensearch/1.1/"><opensearch:totalResults>{}</opensearch:totalResults>{}</feed>'


def write_feed(path, total, entries):
    path.mkdir()
    (path / "page.xml").write_text(FEED.format(total, "".join(entries)))
    return str(path)


def test_feed_files(spark, tmp_path):
    path = write_feed(tmp_path / "day", 2, ENTRIES)
    entries = feed.read_feed(spark, path)
    rows = {r.versioned_id: r for r in feed.papers_of(feed.check_feed(entries, feed.feed_total(spark, path))).collect()}
    assert rows["2607.00001v2"].authors == ["Ann Lee", "Bo"] and rows["2607.00001v2"].pdf_url.endswith("pdf/2607.00001v2")
    stored = {r.arxiv_id: r for r in feed.records_of(entries).collect()}
    assert stored["quant-ph/0201082"].version == 1 and stored["2607.00001"].affiliations == {"Ann Lee": ["MIT"]}


def test_feed_has_to_be_whole(spark, tmp_path):
    path = write_feed(tmp_path / "short", 3, ENTRIES)
    with pytest.raises(ValueError, match="2 of 3"):
        feed.check_feed(feed.read_feed(spark, path), feed.feed_total(spark, path))
    path = write_feed(tmp_path / "error", 1, ["<entry><id>x</id><title>Error</title><summary>bad query</summary></entry>"])
    with pytest.raises(ValueError, match="bad query"):
        feed.check_feed(feed.read_feed(spark, path), 1)


def test_line_numbers_over_partitions(spark, tmp_path):
    (tmp_path / "x.txt").write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = jsonl.numbered_lines(spark, str(tmp_path / "x.txt"))
        assert lines.where(F.concat(F.lit("line "), F.col("line").cast("string")) == F.col("value")).count() == 5000
        assert lines.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_and_counts_are_written(spark, tmp_path):
    df = spark.createDataFrame([(2, None, "é"), (1, "a", "x")], "n int, b string, a string")
    jsonl.write_lines(df, str(tmp_path / "lines"), ["n"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "lines").glob("part-*")))
    assert text == '{"a":"x","b":"a","n":1}\n{"a":"é","b":null,"n":2}\n'
    jsonl.write_counts(spark.createDataFrame([("2026-07-04", 1), ("2026-07-03", 2)], "date string, paper_count int"), str(tmp_path / "counts"))
    (part,) = (tmp_path / "counts").glob("part-*")
    assert part.read_text() == "date,paper_count\n2026-07-03,2\n2026-07-04,1\n"


def test_swap(spark, tmp_path):
    target = str(tmp_path / "out")
    files = Files(spark, target)

    def fill(text):
        return lambda stage: files.write(f"{stage}/a.txt", text)

    replace_directory(spark, target, fill("one"))
    replace_directory(spark, target, fill("two"))
    assert files.read(f"{target}/a.txt") == "two" and files.under(target) == ["a.txt"]
    assert files.sha256(f"{target}/a.txt") == hashlib.sha256(b"two").hexdigest()

    def broken(stage):
        fill("three")(stage)
        raise KeyError("stop")

    with pytest.raises(KeyError):
        replace_directory(spark, target, broken)
    assert files.read(f"{target}/a.txt") == "two" and sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == ["out"]

    # A crash after the old folder went aside, and one after the new folder came in.
    files.rename(target, str(tmp_path / ".out.backup"))
    recover(files, target)
    assert files.read(f"{target}/a.txt") == "two"
    files.make(str(tmp_path / ".out.backup"))
    recover(files, target)
    assert files.exists(target) and not files.exists(str(tmp_path / ".out.backup"))
    files.claim(str(tmp_path / ".out.lock"))
    with pytest.raises(RuntimeError, match="lock"):
        replace_directory(spark, target, fill("four"))
    assert files.read(f"{target}/a.txt") == "two"


def test_shards_hold_the_source(spark, tmp_path):
    """Every source row is in the shard of its day, in order, and the manifest's counts and hashes are those of the files."""
    days = ["2026-07-03", "2026-07-04", "2026-07-03", "2026-07-05"]
    source = [{"arxiv_id": str(i), "versioned_id": f"{i}v1", "submitted_date": days[i % 4], "title": "t", "abstract": "We show that it improves." if i % 3 else "Nothing."} for i in range(60)]
    path, target = tmp_path / "x.jsonl", tmp_path / "out"
    path.write_text("\n".join(map(json.dumps, source)))
    manifest = shards.write_claim_shards(spark, str(path), str(target), 60)
    assert json.loads((target / "manifest.json").read_text()) == manifest
    assert manifest["source_sha256"] == hashlib.sha256(path.read_bytes()).hexdigest()
    written = {}
    for shard in manifest["shards"]:
        data = (target / shard["file"]).read_bytes()
        assert shard["sha256"] == hashlib.sha256(data).hexdigest()
        written[shard["file"].removesuffix(".jsonl")] = [json.loads(x) for x in data.splitlines()]
        assert shard["paper_count"] == len(data.splitlines())
    for day in set(days):
        assert [r["arxiv_id"] for r in written[day]] == [r["arxiv_id"] for r in source if r["submitted_date"] == day]
    assert all(r["status"] == ("extracted" if r.get("validity_envelopes") else "no_supported_claim") for rows in written.values() for r in rows)
    hashes = {r.file: r.sha256 for r in shards.file_hashes(spark, str(target)).collect()}
    assert all(hashes[s["file"]] == s["sha256"] for s in manifest["shards"])


def test_metadata(spark, tmp_path):
    facts = shards.curation_facts("2026-07-03", "2026-07-15", 9, 12, spark.range(7))
    shards.write_metadata(spark, str(tmp_path / "metadata.json"), facts)
    read = json.loads((tmp_path / "metadata.json").read_text())
    assert read == facts and read["curation"]["removed_paper_count"] == 5 and read["paper_count"] == 7


def test_remote_extractor(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string")
    ask = features.remote_extractor(lambda p: json.dumps({"methods": [p]}), "methods array<string>")
    assert {r.id: r.features.methods for r in ask(df).collect()} == {1: ["a"], 2: ["b"]}
    with pytest.raises(Exception, match="gave no features|MALFORMED"):
        features.remote_extractor(lambda p: None, "methods array<string>")(df).collect()


def example_lines(n=24):
    robots, cells = "robot arm grasps an object with a gripper", "protein cell membrane gene expression"
    return [{"arxiv_id": f"{k}{i}", "title": f"{words.split()[i % 4]} study", "abstract": f"{words} number {i % 5}", "primary_category": c} for i in range(n) for k, words, c in (("r", robots, "cs.RO"), ("q", cells, "q-bio.GN"))]


@pytest.mark.parametrize("kind", [classifier.NET, classifier.LOGISTIC])
def test_classifier(spark, tmp_path, kind):
    path, model = tmp_path / "x.jsonl", str(tmp_path / "model")
    rare = [{"title": "t", "abstract": "a", "primary_category": "econ.TH"}]
    path.write_text("\n".join(map(json.dumps, example_lines() + rare)))
    run = classifier.train_and_evaluate(jsonl.read_examples(spark, str(path)), features=60, model=kind, iterations=(2, 5))
    assert run.classifier.labels == ["cs.RO", "q-bio.GN"]
    assert {r.split: r.n for r in run.split.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()} == {"train": 32, "validation": 8, "test": 8}
    assert run.metrics["accuracy"] == 1.0 and run.metrics["uniform_baseline"] == 0.5 and 0 <= run.metrics["untrained_validation_accuracy"] <= 1
    assert run.curve(spark).where(F.col("epoch") == run.metrics["best_epoch"]).count() == 1 and run.mistakes.count() == 0 == run.confusion.count()
    # Only training papers give the vocabulary its terms.
    trained = {w for r in run.split.where("split = 'train'").collect() for w in r.text.lower().split()}
    words = {r.term for r in run.classifier.vocabulary.terms.where("block = 'w'").collect()}
    assert all(set(term.split()) <= trained for term in words)

    classifier.save(run.classifier, model)
    again = classifier.load(spark, model)
    paper = spark.createDataFrame([("1", "a robot arm grasps an object"), ("2", "protein cell membrane gene expression")], "arxiv_id string, text string")
    told = {r.arxiv_id: (r.predicted, [x.label for x in r.ranked]) for r in again.predict(paper, 2).collect()}
    assert told == {"1": ("cs.RO", ["cs.RO", "q-bio.GN"]), "2": ("q-bio.GN", ["q-bio.GN", "cs.RO"])}
    files = Files(spark, model)
    files.write(f"{model}/labels.json", '["x", "y"]')
    with pytest.raises(ValueError, match="manifest"):
        classifier.load(spark, model)


def test_net_gradients():
    """Against differences, and with dropout that keeps everything."""
    import numpy as np

    from vellumflow.operators import net

    rng = np.random.default_rng(0)
    w = [x.astype(float) for x in net.initial(5, 3, 4, rng)]
    x, y, weight = rng.random((6, 5)), np.array([0, 1, 2, 0, 1, 1]), rng.random(6) + 0.5
    _, _, grads = net.gradients(w, x, y, weight, np.ones((6, 4)))
    for layer, g in zip(w, grads, strict=True):
        for at in np.ndindex(layer.shape):
            layer[at] += 1e-5
            up = net.gradients(w, x, y, weight, None)[0]
            layer[at] -= 2e-5
            down = net.gradients(w, x, y, weight, None)[0]
            layer[at] += 1e-5
            assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)
    assert all((a == b).all() for a, b in zip(w, net.unpacked(net.packed(w)), strict=True))


def test_net_stops_early():
    import numpy as np

    from vellumflow.operators import net

    x = net.Sparse([[0], [1]] * 8, [[1.0], [1.0]] * 8, 2)
    y = np.array([0, 1] * 8)
    w, told = net.train({"train": (x, y), "validation": (x, y)}, np.ones(2), 2, 8, 0.0, 4, 0.1, 1e-4, 50, 3, 1)
    assert told["history"][told["best_epoch"] - 1]["validation_macro_f1"] == 1.0 and len(told["history"]) == told["best_epoch"] + 3
    assert net.scores(w, x, y, 4)[1] == 1.0


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(command, "session", lambda: spark)
    path, model = tmp_path / "x.jsonl", str(tmp_path / "model")
    path.write_text("\n".join(map(json.dumps, example_lines(12))))
    assert command.main(["train", str(path), model, "--features", "40"]) == 0
    assert json.loads(capsys.readouterr().out)["accuracy"] == 1.0
    assert command.main(["predict", model, "--title", "Robot", "--abstract", "A robot arm grasps an object with a gripper", "--top", "1"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["label"] == "cs.RO"


def test_accents_do_not_count(spark):
    docs = spark.createDataFrame([("1", "café naïve"), ("2", "cafe naive")], "arxiv_id string, text string")
    rows = docs.select(classifier._blocks()["w"].alias("w")).collect()
    assert rows[0].w == rows[1].w == ["cafe", "naive", "cafe naive"]


def test_search_source(spark, monkeypatch):
    from datetime import datetime
    from pathlib import Path

    from vellumflow.operators.upsert import capped
    from vellumflow.sources import search

    monkeypatch.syspath_prepend(str(Path(__file__).parent))
    spark.sparkContext.addPyFile(str(Path(__file__).parent / "fake_search.py"))
    query = search.search_query(["cs.LG", "cs.RO"], datetime(2026, 7, 3), datetime(2026, 7, 4, 1, 2))
    assert query == "(cat:cs.LG OR cat:cs.RO) AND submittedDate:[202607030000 TO 202607040102]"
    few = search.search(spark, "fake_search:client", query, 120, pause=0)
    assert [r.arxiv_id for r in few.collect()] == [f"{i:04d}" for i in range(121)] and few.head().title == query
    kept, over = capped(few, 120, ["arxiv_id"])
    assert over and kept.count() == 120
    every = search.search(spark, "fake_search:client", "q", 500, search.UPDATED, pause=0)
    assert every.count() == 250 and every.head().arxiv_id == "0249"
    with pytest.raises(Exception, match="no connection"):
        search.search(spark, "fake_search:client", "down", 5, pause=0).collect()
    with pytest.raises(ValueError):
        search.search_query([])


def test_net_learns_alike_on_any_partitions(spark):
    """The same loss curve with one block, and with rows spread over 1 and 8 partitions, to a thousandth."""
    import numpy as np

    from vellumflow.operators import net

    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 300)
    index = [sorted({int(c) * 4 + int(i) for i in rng.integers(0, 5, 3)}) for c in y]
    rows = [(str(i), "train" if i % 4 else "validation", (ix, [1.0] * len(ix)), int(c)) for i, (ix, c) in enumerate(zip(index, y, strict=True))]
    df = spark.createDataFrame(rows, "id string, split string, features struct<index:array<int>,value:array<double>>, y int")
    told = [net.fit(df.repartition(n), "id", 16, [1.0, 2.0, 1.0], hidden=8, batch=32, rate=0.02, epochs=4, patience=4)[1] for n in (1, 8)]
    assert told[0]["best_epoch"] == told[1]["best_epoch"]
    for a, b in zip(*(t["history"] for t in told), strict=True):
        assert a == pytest.approx(b, abs=1e-3)
    assert told[0]["history"][-1]["train_loss"] < 0.9 * told[0]["history"][0]["train_loss"]


def test_dense_vectors(spark):
    df = spark.createDataFrame([(1, ([0, 3, 5], [1.0, 2.0, 3.0])), (2, ([], [])), (3, ([5], [4.0]))], "id int, features struct<index:array<int>,value:array<double>>")
    got = {r.id: r.v.toArray().tolist() for r in df.select("id", classifier._vector(6, "features.index", "features.value").alias("v")).collect()}
    assert got == {1: [1, 0, 0, 2, 0, 3], 2: [0] * 6, 3: [0] * 5 + [4]}
