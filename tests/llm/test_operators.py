"""The ten operators against brute force, and their results on odd rows and empty tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumflow.llm import ann, chat_format, license_scan, line_dedup, near_dedup, packing, quality, secret_scan, sentencepieces, substring_dedup

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SPACED = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").persist()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_license_places(docs, texts):
    got = by_id(license_scan.scan_licenses(docs))
    for i, t in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(UPPER))
        places = [(j, label) for p, label in license_scan.PHRASES.items() for j in range(len(words)) if words[j : j + len(p.split())] == p.split()]
        assert (got[i].n_words, got[i].n_base) == (len(words), len(places))
        assert got[i].base_labels == ",".join(sorted({x for _, x in places}))


def test_license_notice_with_edits(spark):
    notice = list(license_scan.NOTICES)[0].split()
    edited = " ".join(["noise"] * 9 + notice[:12] + ["extra"] + notice[12:])
    df = spark.createDataFrame([(1, edited), (2, "Under the MIT License. under the mit license"), (3, "licence words only")], "doc_id long, text string")
    got = by_id(license_scan.scan_licenses(df))
    assert got[1].labels == "mit" and 0.6 <= got[1].score < 1
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].score) == (2, 0, 4, 1.0)
    assert got[3].labels == "" and got[3].first_word is None


def brute_notices(t):
    """Labels and score of a text: of each notice's diagonals, neighbouring ones in a run, the share of its 3-word runs that are covered."""
    k = license_scan.GRAM
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(UPPER))
    places = collections.defaultdict(list)
    for i in range(len(words) - k + 1):
        places[tuple(words[i : i + k])].append(i)
    labels, score = set(), 0.0
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        if any(words[i : i + len(p)] == p for i in range(len(words))):
            labels.add(label)
            score = 1.0
    for notice, label in license_scan.NOTICES.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", notice.translate(UPPER))
        n = len(w) - k + 1
        votes = collections.defaultdict(set)
        for at in range(n):
            for i in places.get(tuple(w[at : at + k]), []):
                votes[i - at].add(at)
        run, last = set(), None
        best = 0.0
        for d in sorted(votes):
            run = run | votes[d] if last is not None and d - last <= license_scan.SHIFT else set(votes[d])
            last = d
            best = max(best, len(run) / n)
        if best >= license_scan.COVER:
            labels.add(label)
            score = max(score, best)
    return ",".join(sorted(labels)), score


def test_license_labels_and_score(spark, docs):
    """Whole, cut, shuffled and edited notices at any place of other text, and the given documents."""
    rng = np.random.default_rng(8)
    made = []
    for notice in license_scan.NOTICES:
        w = notice.split()
        for share in (1.0, 0.9, 0.75, 0.6, 0.4):
            kept = [x for x in w if rng.random() < 0.3 + 0.7 * share]
            made.append(" ".join(["lorem"] * int(rng.integers(0, 30)) + kept + ["ipsum"] * int(rng.integers(0, 30))))
            made.append(" ".join(w[: int(len(w) * share)]) + " dolor " * int(rng.integers(0, 9)) + " ".join(w[int(len(w) * share) :]))
        made.append(" ".join(rng.permutation(w)))
        made.append(notice + " " + notice)
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(made)], "doc_id long, text string"))
    want = {r.doc_id: brute_notices(r.text or "") for r in df.collect()}
    got = {i: (r.labels, r.score) for i, r in by_id(license_scan.scan_licenses(df)).items()}
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1]) for i in want)
    assert 0 < sum(bool(want[10**6 + i][0]) for i in range(len(made))) < len(made)


def spans_of(t):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark, docs):
    made = ["secret=token: abcdefgh", "token=abc token=token=abcdef", "😀 AKIA" + "Z" * 16 + " x", "PassWord : 'abcdef'", "0" * 23 + " " + "f" * 24, ""]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(made)], "doc_id long, text string"))
    for r in secret_scan.find_secrets(df).collect():
        assert [tuple(s) for s in r.base] == spans_of(r.text)


def test_markov_models_on_held_out_strings(spark):
    model = secret_scan.train(secret_scan.labelled_samples(spark))
    secrets = [hashlib.sha256(f"held{i}".encode()).hexdigest()[:40] for i in range(100)]
    import base64

    secrets += [base64.b64encode(hashlib.sha256(f"h{i}".encode()).digest()).decode()[:32] for i in range(100)]
    names = ["getUserAccountBalanceByIdentifier", "maximum_number_of_connections", "src/main/resources/application", "internationalization-support", "VERY_LONG_CONSTANT_NAME_VALUE", "Donaudampfschifffahrtsgesellschaft"]
    df = spark.createDataFrame([(i, f"see {t} now") for i, t in enumerate(secrets + names)], "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in secret_scan.find_secrets(df, model).collect()}
    hits = sum(3 in got[i] for i in range(len(secrets)))
    assert hits >= 0.95 * len(secrets)
    assert not any(3 in got[i] for i in range(len(secrets), len(secrets) + len(names)))


def test_markov_secrets_behind_names(spark):
    import base64

    before = ["AWS_SECRET_ACCESS_KEY=", "database_connection_string=", "/services/notification/channel/"]
    digests = [hashlib.sha256(f"behind{i}".encode()) for i in range(60)]
    parts = [(k, d.hexdigest()[:20] if i % 2 else base64.b64encode(d.digest()).decode()[:40]) for i, d in enumerate(digests) for k in before]
    names = [f"{k}maximum_number_of_connections/src/main/resources" for k in before]
    rows = [f"see {k}{s} now" for k, s in parts] + [f"see {k} now" for k in names]
    model = secret_scan.train(secret_scan.labelled_samples(spark))
    found = secret_scan.find_secrets(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), model)
    got = {r.doc_id: r for r in found.select("doc_id", "spans", secret_scan.masked("text", "spans").alias("masked")).collect()}
    hits = [got[i].masked == "see [SECRET] now" for i in range(len(parts))]
    assert sum(hits) >= 0.95 * len(parts)
    assert not any(s.kind == 3 for i in range(len(names)) for s in got[len(parts) + i].spans)

    # The same as brute force over all sub-runs of 20 characters or more.
    n = len(secret_scan.ALPHABET)

    def brute(run):
        at = [secret_scan.ALPHABET.index(c) for c in run]
        x = [model[a * n + b] for a, b in zip(at, at[1:], strict=False)]
        return any(np.mean(x[i:j]) >= secret_scan.THRESHOLD for i in range(len(x)) for j in range(i + secret_scan.LEAST_SCORED - 1, len(x) + 1))

    for i, text in enumerate(rows):
        assert any(s.kind == 3 for s in got[i].spans) == brute(text[4:-4])


def test_masking(spark):
    df = spark.createDataFrame([(1, "a token=abcdef0123 b " + "0" * 30), (2, "plain")], "doc_id long, text string")
    got = {r.doc_id: r.t for r in secret_scan.find_secrets(df).select("doc_id", secret_scan.masked("text", "spans").alias("t")).collect()}
    assert got == {1: "a [SECRET] b [SECRET]", 2: "plain"}


def test_masking_of_many_spans(spark):
    """Against a loop, on long texts with overlapping, touching and many spans."""
    rng = np.random.default_rng(4)
    rows = []
    for i, n in enumerate((5, 1023, 1024, 1025, 5000, 60_000)):
        text = "".join(rng.choice(list("ab é😀\n日"), n))
        at = sorted(rng.integers(0, n, max(1, n // 20)).tolist())
        rows.append((i, text, [(a, 0, min(n, a + int(rng.integers(1, 30)))) for a in at]))
    rows.append((6, "abcdef", [(0, 0, 2), (2, 1, 4), (5, 0, 6)]))
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:int,kind:int,end:int>>")
    for r in df.withColumn("got", secret_scan.masked("text", "spans")).collect():
        out, at = [], None
        for a, _, b in r.spans:
            if at is None or a > at:
                out += [r.text[at or 0 : a], secret_scan.MASK]
            at = max(at or 0, b)
        assert r.got == "".join(out) + r.text[at:]


def test_markov_spares_names_of_another_source(spark):
    """Long names of Python's own library, which has no part in the training sample."""
    import ast
    import email
    import http.client
    import inspect
    import logging.handlers
    import ssl
    import unittest.mock
    import xml.dom.minidom

    names = set()
    for module in (ast, email, http.client, inspect, logging.handlers, ssl, unittest.mock, xml.dom.minidom):
        names |= set(re.findall(r"[A-Za-z_]{20,}", inspect.getsource(module)))
    names = sorted(n for n in names if not n.startswith("_"))
    assert len(names) > 100
    df = spark.createDataFrame([(i, f"x {n} y") for i, n in enumerate(names)], "doc_id long, text string")
    wrong = [names[r.doc_id] for r in secret_scan.find_secrets(df).collect() if any(s.kind == 3 for s in r.spans)]
    assert len(wrong) <= 0.02 * len(names), wrong


def stats_of(t):
    w = re.findall(SPACED, t)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, marked = collections.Counter(grams), [False] * len(w)
    for i, g in enumerate(grams):
        if count[g] > 1:
            marked[i : i + 8] = [True] * 8
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(SPACED, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(marked)


def test_quality(spark, docs, texts):
    repeated = {10**6: "a b c d e f g h i " * 5, 10**6 + 1: "x\nx\n y\n\n\ny", 10**6 + 2: "é | # 日本 $"}
    df = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame([(i, t, "en", "s") for i, t in repeated.items()], "doc_id long, text string, lang string, source string"))
    for r in quality.judge(df).collect():
        want = stats_of((texts | repeated)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_quality_outliers(spark):
    rng = np.random.default_rng(1)
    words = ["river", "stone", "under", "light", "green", "table", "often", "seven"]
    words += [a + b for a in words for b in ("s", "ed", "ing")]
    rows = [(i, " ".join(rng.choice(words, rng.integers(60, 200))), "en", "s") for i in range(200)]
    rows += [(1000 + i, " ".join(w + "&&&" for w in rng.choice(words, 80)), "en", "s") for i in range(5)]
    got = by_id(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert all(got[i].kept for i in range(200)) and not any(got[1000 + i].kept for i in range(5))


def test_quality_judges_small_groups(spark):
    rng = np.random.default_rng(2)
    words = ["river", "stone", "under", "light", "green", "table", "often", "seven"]
    words += [a + b for a in words for b in ("s", "ed", "ing")]
    text = lambda end="": " ".join(w + end for w in rng.choice(words, rng.integers(60, 200)))
    # 20 rows a source, a source of one row, and a language of few rows: all under LEAST_ROWS.
    rows = [(i, text(), "en", f"s{i % 10}") for i in range(200)] + [(200 + i, text(), "de", "s0") for i in range(5)]
    rows += [(1000, text("&&&"), "en", "s3"), (1001, text("###"), "en", "alone"), (1002, text("$$$"), "de", "s0")]
    got = by_id(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert all(r.distance is not None for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {1000, 1001, 1002}
    # So few rows say little about their spread.
    few = quality.judge(spark.createDataFrame([(i, text(), "en", "s") for i in range(4)] + [(4, text() * 8, "en", "s")], "doc_id long, text string, lang string, source string"))
    assert [r.kept for r in few.where("not base_failed").collect()].count(False) == 0


def brute_mcd(x, rng):
    """Least determinant of the scatter of a core (three quarters of the rows), over random starts and steps until nothing changes."""
    floors = np.array([(quality.SCALE * v) ** 2 for v in quality.FLOORS.values()])
    fit = lambda rows: (rows.mean(axis=0), quality.CONSISTENCY * np.cov(rows.T, bias=True) + np.diag(floors))
    best = None
    for _ in range(60):
        centre, scatter = fit(x[rng.choice(len(x), 8, replace=False)])
        last = np.inf
        while True:
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
            centre, scatter = fit(x[np.argsort(d)[: int(len(x) * quality.CORE) + 1]])
            log_det = np.linalg.slogdet(scatter)[1]
            if log_det >= last - 1e-9:
                break
            last = log_det
        if best is None or log_det < best[0]:
            best = log_det, centre, scatter
    return best


def test_quality_is_least_determinant(spark):
    """The verdicts against numpy's over many random starts, with a fifth of the rows in a cluster of its own."""
    rng = np.random.default_rng(12)
    words = ["river", "stone", "under", "light", "green", "table", "often", "seven"]
    words += [a + b for a in words for b in ("s", "ed", "ing", "ly")]
    texts = [" ".join(rng.choice(words, rng.integers(60, 300))) for _ in range(240)]
    texts += [" ".join(w + "#&" for w in rng.choice(words[:6], rng.integers(60, 90))) for _ in range(60)]
    texts += [" ".join(f"{w}{rng.integers(0, 10**6)}" for w in rng.choice(words, 100)) for _ in range(6)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = by_id(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    import pyarrow as pa

    counts = quality.text_counts(pa.array(texts))
    x = np.stack(quality._features(counts), axis=1).astype(float)
    passing = np.array([not got[i].base_failed for i in range(len(texts))])
    log_det, centre, scatter = brute_mcd(x[passing], rng)
    d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
    sure = passing & (np.abs(d / quality.CUTOFF - 1) > 0.2)
    assert sure.sum() > 250
    assert all(got[i].kept == (d[i] <= quality.CUTOFF) for i in np.flatnonzero(sure))
    assert not any(got[i].kept for i in range(240, 306))


def removed(all_texts, n=35):
    words = {i: re.findall(SPACED, t) for i, t in all_texts.items()}
    count = collections.Counter(tuple(w[i : i + n]) for w in words.values() for i in range(len(w) - n + 1))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_substrings(spark, texts, monkeypatch):
    rng = np.random.default_rng(3)
    own = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage, made = own(60), {}
    for i in range(12):
        made[10**6 + i] = " ".join(own(40) + passage[: 34 + i] + own(50) + (passage[i:] if i % 3 == 0 else []))
    made[2 * 10**6] = "a " * 200
    made[2 * 10**6 + 1] = "a b " * 80
    every = texts | made
    df = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    want = removed(every)
    for hot in (4096, 1):
        monkeypatch.setattr(substring_dedup, "HOT_CONTEXTS", hot)
        got = by_id(substring_dedup.remove_repeats(df))
        assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == want


def test_neighbours(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = collections.defaultdict(list)
    for r in ann.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    rows = table.orderBy("vec_id").toPandas()
    x, ids = np.stack(rows.embedding.to_numpy()).astype(float), rows.vec_id.to_numpy()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]])
        hits += len(best & {i for i, _ in got[ids[q]]})
        total += 20
        assert all(abs(score - s[np.flatnonzero(ids == i)[0]]) < 1e-9 for i, score in got[ids[q]])
    assert hits >= 0.9 * total


def test_neighbours_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [2.0, 0.0]), (6, [2.0, 0.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0, 3.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df).collect()] == [(0, 1, 5, 2.0), (0, 2, 6, 2.0)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_neighbours_of_repeated_ids_and_hot_vectors(spark):
    """Against brute force over rows: repeated ids, a third of all rows with one vector, clashing names, two lengths of vectors."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(24).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 24) for i in range(150)]
    rows += [(40, rng.standard_normal(24).tolist()), (40, rows[60][1]), (60, rows[60][1]), (60, rows[60][1])]
    rows += [(2000 + i, (rng.standard_normal(3) * 1e30).tolist()) for i in range(30)]
    df = spark.createDataFrame([(*r, 0, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, row int, dim string, score double")
    got = collections.Counter()
    for q in df.transform(ann.nearest).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("r")).collect():
        got[q.query_id] = q.r
    for i in {i for i, _ in rows if i % 20 == 0}:
        own = [n for n, (j, _) in enumerate(rows) if j == i]
        want = []
        for n in own:
            there = [m for m in range(len(rows)) if m != n and len(rows[m][1]) == len(rows[n][1])]
            scored = sorted((-float(np.dot(rows[n][1], rows[m][1])), rows[m][0]) for m in there)[:20]
            want += [(rank + 1, j, -x) for rank, (x, j) in enumerate(scored)]
        want.sort(key=lambda x: (x[0], x[1]))
        have = sorted(((r.rank, r.vec_id, r.score) for r in got[i]), key=lambda x: (x[0], x[1]))
        assert [x[0] for x in have] == [x[0] for x in want]
        # Bounds fail rarely; the products are exact.
        assert sum(a[1] == b[1] for a, b in zip(have, want, strict=True)) >= 0.9 * len(want)
        assert all(a[2] == pytest.approx(b[2], rel=1e-9) for a, b in zip(have, want, strict=True) if a[1] == b[1])


def test_codes_bound_products():
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((500, 70)) * rng.lognormal(0, 2, (500, 1))
    codes, norms, f = ann.encode(vectors)
    rows = np.arange(500)
    block = ann.Block({"dim": 70, "rows": rows.tobytes(), "ids": rows.tobytes(), "codes": codes.tobytes(), "norms": norms.tobytes(), "f": f.tobytes()})
    queries, inside = ann.Queries(rows[:40], vectors[:40]), 0
    for a, low, high in queries.bounds(block):
        exact = vectors[a : a + ann.TILE] @ vectors.T
        assert all(low[i, a + i] == high[i, a + i] == -np.inf for i in range(len(low)))
        inside += ((low <= exact) & (exact <= high)).sum()
    assert inside >= 0.99 * 40 * 499


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.vocabulary_path())
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack_documents(docs).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in texts.items():
        ids = np.array([*slow.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for n, p in enumerate(sorted(pieces[i], key=lambda p: p.piece)):
            assert (p.piece, p.start) == (n, at) and (n == 0 or p.length == 2048)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= 1.02 * -(-sum(p.length for x in pieces.values() for p in x) // 2048)


def test_special_string_reads_as_by_tokenizers():
    text = "a <|endoftext|> b"
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    assert packing.token_ids(text, path) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


LONG_RUNS = {"blanks": " " * 2_000_000, "lines": "\n" * 2_000_000, "mixed": "a " + " \n\t\u00a0" * 400_000 + " word" + "\u3000 " * 200_000, "between": "x" + " " * 70_000 + "y", "letters": "x" * 500_000}


def test_long_runs_of_blanks(spark):
    path = packing.vocabulary_path()
    df = spark.createDataFrame(list(enumerate(LONG_RUNS.values())), "doc_id long, text string").repartition(2)
    got = {}
    for r in packing.pack_documents(df).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, text in enumerate(LONG_RUNS.values()):
        ids = np.array([*packing._slow(path).encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert sum(n for _, n, _ in got[i]) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in got[i])


def test_local_search_empties_bins():
    bins = collections.Counter({(6,): 2, (4, 4): 1, (3,): 2})
    out = packing.local_search(bins, 10)
    assert sum(out.values()) < 5 and collections.Counter(x for p, n in out.items() for x in p * n) == collections.Counter({6: 2, 4: 2, 3: 2})
    assert all(sum(p) <= 10 for p in out)


def test_local_search_against_best_fit(docs):
    """The search alone, from one piece a bin, needs as few bins as any packing on documents, and fewer than best fit on lengths near a third."""
    rng = np.random.default_rng(6)
    documents = collections.Counter(r.length for r in packing.cut(docs).select("length").collect())
    cases = [documents, collections.Counter(rng.integers(600, 760, 600).tolist()), collections.Counter(rng.integers(1025, 2049, 300).tolist()), collections.Counter(rng.integers(1, 2049, 400).tolist()), collections.Counter({2048: 3, 1024: 5, 1: 2})]
    for histogram in cases:
        alone = collections.Counter({(x,): n for x, n in histogram.items()})
        found, greedy = packing.local_search(alone, 2048), packing.best_fit(histogram, 2048)
        assert collections.Counter(x for p, n in found.items() for x in p * n) == histogram
        assert all(sum(p) <= 2048 for p in found)
        assert packing.lower_bound(histogram, 2048) <= sum(found.values()) <= sum(greedy.values())
    assert sum(packing.packed_bins(documents, 2048).values()) == packing.lower_bound(documents, 2048)
    assert sum(packing.packed_bins(cases[1], 2048).values()) < sum(packing.best_fit(cases[1], 2048).values())


def test_lower_bound_holds():
    """Against the fewest bins of small cases, by trying all."""

    def fewest(rest, rooms):
        if not rest:
            return len(rooms)
        best = fewest(rest[1:], [*rooms, 10 - rest[0]])
        for i, room in enumerate(rooms):
            if room >= rest[0]:
                best = min(best, fewest(rest[1:], [*rooms[:i], room - rest[0], *rooms[i + 1 :]]))
        return best

    rng = np.random.default_rng(2)
    for _ in range(40):
        lengths = rng.integers(1, 11, 6).tolist()
        histogram, least = collections.Counter(lengths), fewest(sorted(lengths, reverse=True), [])
        assert packing.lower_bound(histogram, 10) <= least <= sum(packing.packed_bins(histogram, 10).values()) <= least + 1


def test_sentencepiece_ids(spark, docs, texts):
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(sentencepieces.encode(docs, path))
    for i, t in texts.items():
        assert got[i].ids == sp.encode(t) and got[i].round_trip
    made = ["Hello  world\n new", "  a", "", " ", "x" * 300, "abc" * 400 + " " * 70 + "z", "\x00á 😀😀", None]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    ids = sentencepieces.encode(df, path)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: sp.encode(t or "") for i, t in enumerate(made)}
    assert {r.doc_id: r.text for r in sentencepieces.decode(ids, path).collect()} == {i: t or "" for i, t in enumerate(made)}


def test_sentencepiece_merges_of_odd_texts():
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.load(path)
    rng = np.random.default_rng(5)
    # Runs of blanks have pieces of equal scores; long words without blanks; characters that are no pieces.
    made = [" " * k + w + " " * j for k in range(0, 40, 3) for w in ("", "the", "é") for j in range(0, 40, 3)]
    made += ["".join(rng.choice(list("abcdeinrst ▁éÀ日0123456789.,\n-_/"), rng.integers(1, 200))) for _ in range(800)]
    made += ["aaaaaaa" * 60, "日本語のテキスト" * 300, "http://www.example.com/index.php?id=123456789&foo=bar" * 9]
    ids, counts = sentencepieces.encode_batch(model, made)
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [sp.encode(t) for t in made]


def test_viterbi_is_best(texts):
    import public_tokenizers

    model = sentencepieces.load(str(public_tokenizers.path("piece_bpe_32k.model")), sentencepieces.UNIGRAM)
    scores = {t: s for t, s, k in zip(model.texts, model.scores, model.kinds, strict=True) if k == sentencepieces.NORMAL}
    some = sorted({w for t in list(texts.values())[:20] for w in t.split()})[:600]
    ids, counts = sentencepieces.encode_batch(model, some)
    ends = np.cumsum(counts)
    assert sentencepieces.decode_batch(model, ids, counts) == some
    for w, e, n in zip(some, ends, counts, strict=True):
        t = "▁" + w
        best = [0.0] + [-np.inf] * len(t)
        for j in range(1, len(t) + 1):
            for i in range(max(0, j - model.longest), j):
                score = scores.get(t[i:j], model.unknown if j - i == 1 else -np.inf)
                best[j] = max(best[j], best[i] + score)
        own = ids[e - n : e]
        unknown = sum(c not in scores for c in t)
        got = sum(model.scores[i] for i in own if model.kinds[i] == sentencepieces.NORMAL) + unknown * model.unknown
        assert got == pytest.approx(best[-1])


def key_of(line):
    return line.strip(" \t\n\r\x0b\x0c").translate(UPPER)


def test_lines(spark, texts):
    long = "A line that is long enough to be counted at all, é"
    made = {10**6 + i: f"own {i}\n  {long if i % 2 else long.lower()} \t\nshort" for i in range(5)}
    made |= {2 * 10**6 + i: "four copies of this line are not enough to drop it" for i in range(4)}
    every = texts | made
    df = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    held = collections.defaultdict(set)
    for i, t in every.items():
        for line in t.split("\n"):
            if len(key_of(line)) >= 40:
                held[key_of(line)].add(i)
    for batches in (1, 4):
        got = by_id(line_dedup.drop_common_lines(df, batches=batches))
        for i, t in every.items():
            lines = t.split("\n")
            kept = [x for x in lines if not (len(key_of(x)) >= 40 and len(held[key_of(x)]) >= 5 and max(held[key_of(x)]) != i)]
            assert (got[i].n_lines, got[i].n_dropped, got[i].kept_text) == (len(lines), len(lines) - len(kept), "\n".join(kept))


def brute_components(every, size=4):
    sets = {}
    for i, t in every.items():
        w = re.findall(SPACED, t.translate(UPPER))
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    where, common, parent = collections.defaultdict(list), collections.Counter(), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for ids in where.values():
        common.update((a, b) for n, a in enumerate(ids) for b in ids[n + 1 :])

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(spark, texts):
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 9999, 120)]
    made = {}
    for i in range(60):
        words = list(base)
        for j in rng.integers(0, len(words), i % 12):
            words[j] = f"n{rng.integers(0, 10**6)}"
        made[10**6 + i] = " ".join(words)
    made |= {2 * 10**6 + i: t for i, t in enumerate(["a b", "A  b", "a b c d e f g h", "a b c d e f g", "x", "x", ""])}
    every = dict(list(texts.items())[:120]) | made
    df = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    got = by_id(near_dedup.near_duplicates(df))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(every)
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "é"), (2, 0, "system", "alone"), (None, None, None, "x"), (3, 0, "a", "same"), (3, 0, "a", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.speaker): r for r in chat_format.rotate(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown"), (3, "a")}
    ann_side = got[(1, "ann")]
    assert [ann_side.text[int(a) : int(b)] for a, b in (m.split(":") for m in ann_side.mask.split(","))] == ["hi<|end|>\n", "é<|end|>\n"]
    assert "<|user name=bob|>\n<|end|>\n" in ann_side.text and "<|system|>\ns<|end|>" in ann_side.text
    assert got[(3, "a")].n_own == 2 and chat_format.rotate(df.limit(0)).count() == 0


def brute_sides(rows, part):
    """Parts of the dialogues from every side, from whole renderings."""
    talks = collections.defaultdict(list)
    for c, turn, role, text in rows:
        talks[c].append((turn is not None, turn or 0, role or "unknown", text or ""))
    out = {}
    for c, turns in talks.items():
        turns.sort()
        for speaker in {t[2] for t in turns} - {"system"}:
            at = 0
            for i, (_, _, role, text) in enumerate(turns):
                name = "system" if role == "system" else "assistant" if role == speaker else f"user name={role}"
                head, body = f"<|{name}|>\n", f"{text}<|end|>\n"
                own = out.setdefault((c, speaker, i // part), [at, 0, 0, "", []])
                own[1] += 1
                own[3] += head + body
                if role == speaker:
                    own[2] += 1
                    own[4].append(f"{at + len(head)}:{at + len(head) + len(body)}")
                at += len(head) + len(body)
    return {k: (a, n, o, t, ",".join(m)) for k, (a, n, o, t, m) in out.items()}


def test_chat_of_any_length(spark):
    roles = ["ann", "bob", None, "system", "é"]
    rows = [(1, i, roles[i % 7 % 5], f"t{i}" * (i % 5)) for i in range(3000)]
    # Many rows of a null turn and of one turn, equal rows, a very long text, a dialogue of one turn.
    rows += [(2, None, "a", f"x{i}") for i in range(1500)] + [(2, 7, "b", "same")] * 1200
    rows += [(3, 1, "a", "long " * 40_000), (3, 2, "b", "😀"), (4, 5, "a", "one"), (None, 1, "a", "no id"), (5, 1, "system", "alone")]
    df = spark.createDataFrame([(*r, 0, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, part int, conv string, start int").repartition(5)
    got = {(r.conv_id, r.speaker, r.part): (r.start, r.n_turns, r.n_own, r.text, r.mask) for r in chat_format.rotate(df).collect()}
    assert got == brute_sides(rows, chat_format.PART)
    assert got[(1, "ann", 2)][0] == len(got[(1, "ann", 0)][3]) + len(got[(1, "ann", 1)][3])
    small = [r for r in rows if r[0] in (3, 4, None)]
    got = {(r.conv_id, r.speaker, r.part): (r.start, r.n_turns, r.n_own, r.text, r.mask) for r in chat_format.rotate(spark.createDataFrame(small, "conv_id long, turn long, role string, text string"), part=1).collect()}
    assert got == brute_sides(small, 1)


ROW_WISE = {
    "license": lambda d: license_scan.scan_licenses(d),
    "secrets": lambda d: secret_scan.find_secrets(d),
    "quality": lambda d: quality.judge(d),
    "substrings": lambda d: substring_dedup.remove_repeats(d),
    "pieces": lambda d: sentencepieces.encode(d),
    "lines": lambda d: line_dedup.drop_common_lines(d),
    "near": lambda d: near_dedup.near_duplicates(d),
    "packing": lambda d: packing.pack_documents(d).where("piece = 0"),
}


@pytest.mark.parametrize("name", ROW_WISE)
def test_odd_rows(odd, empty, name):
    rows = ROW_WISE[name](odd).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == sorted((r.doc_id is not None, r.doc_id or 0) for r in odd.collect())
    assert ROW_WISE[name](empty).count() == 0
