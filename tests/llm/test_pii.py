"""Personal data: base spans against Python's patterns, added spans on rows that the sample doesn't hold."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from vellumflow.llm import pii

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(pii.labelled_sample(spark))


def luhn(digits):
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def base_spans(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 13, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


MADE = [
    "a@b.c_d@e.f, x..y@z-1.co.uk. @no.where a@b a@b. a@b.c@d.e %+-@9.9",
    "1.2.3.4.5.6.7.8 and 256.1.1.1 001.0255.3.4 1.2.3 0.0.0.0 😀 10.0.0.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 378282246310005 0000000000000 4111111111111111 5",
    "+1 (555) 010-9999 ++49 30 123456 +1 2 +123456789012345 +1234567890123456 +4930123456-",
    "+1.2.3.4 +49 (0) 30 1234567 4111 1111 1111 1111+1 555 0109999",
    "9" * 3000 + "@" + "9" * 3000 + "." + "1." * 2000 + "1",
    ("12 " * 30_000) + "1",
    "a" * 6_000 + " " + "b.c" * 2_000,
    "",
]


def test_base_spans(spark, model):
    rng = random.Random(3)
    made = MADE + ["".join(rng.choice("0123456789@.+-() aB:é") for _ in range(400)) for _ in range(60)]
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    df = rows.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(made)], "doc_id long, text string")).repartition(8)
    for r in pii.find_personal_data(df, model).collect():
        assert [(s.kind, s.start, s.end) for s in r.base] == base_spans(r.text)
        spans = sorted((s.start, s.end) for s in r.more)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert all(e <= s.start or b >= s.end for s in r.base for b, e in spans)


HELD = [
    ("My phone is (212) 555-0198, thanks", ["(212) 555-0198"]),
    ("Telefon: 0171/2345678 oder", ["0171/2345678"]),
    ("call +49 151 2345678 or 0151 2345 678 today", ["0151 2345 678"]),
    ("write to jane.doe [at] posteo [dot] org today", ["jane.doe [at] posteo [dot] org"]),
    ("IBAN DE89 3704 0044 0532 0130 00, Berlin", ["DE89 3704 0044 0532 0130 00"]),
    ("her SSN 219-09-9999 leaked", ["219-09-9999"]),
    ("MAC 00:1b:44:11:3a:b7 seen", ["00:1b:44:11:3a:b7"]),
    ("client 2001:0db8:85a3:0000:0000:8a2e:0370:7334 joined", ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"]),
    ("order 302-1234567-7654321 of 2021-03-04, pages 1023-1045", []),
    ("We meet at noon. They arrive at work.the end", []),
    ("ISBN 978-3-16-148410-0, price 12 345 678 EUR", []),
    ("from 1998-2004 some 12.345.678 people, version 10.2.33", []),
    ("build 12:30:45:10 ratio 1:2:3:4", []),
    ("item AB12 CDEF 3456 GH78 90", []),
]


def test_added_spans(spark, model):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HELD)], "doc_id long, text string")
    got = {r.doc_id: [r.text[s.start : s.end] for s in r.more] for r in pii.find_personal_data(df, model).collect()}
    assert got == {i: want for i, (_, want) in enumerate(HELD)}


def test_held_out_accuracy(spark, model):
    """Rows of the sample that neither trees nor thresholds have seen."""
    rows = pii.labelled_sample(spark, 20_000).where("id >= 6000")
    values = pii.features(F.col("kind"), F.col("text"), F.col("before"), F.col("after"))
    rows = rows.select("kind", "label", values.alias("v")).select("kind", "label", (model.probability(F.col("v")) >= model.least(F.col("kind"))).alias("hit"))
    for r in rows.groupBy("kind").agg(F.sum(F.col("hit").cast("int") * F.col("label")).alias("right"), F.sum(F.col("hit").cast("int")).alias("all"), F.sum("label").alias("there")).collect():
        assert r.right / r["all"] > 0.95 and r.right / r.there > 0.7


def test_clean_documents_stay(spark, model):
    """Nothing is added to the given documents, whose personal data are all of the base kinds."""
    found = pii.find_personal_data(spark.read.parquet(f"{SF}/documents.parquet"), model)
    assert found.where("size(more) > 0").count() == 0 and found.where("size(base) > 0").count() > 0


def test_written_and_redacted(spark, model):
    text = "😀 x@y.zz and 10.0.0.1, phone (212) 555-0198."
    df = spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "doc_id long, text string")
    found = pii.find_personal_data(df, model)
    r = found.select("doc_id", pii.written("base", "more").alias("spans")).where("doc_id = 1").collect()[0]
    assert r.spans == "email:2:8,ip:13:21,number:29:43"
    got = {r.doc_id: r.text for r in pii.redacted(found).collect()}
    m = pii.MASK
    assert got == {1: f"😀 {m} and {m}, phone {m}.", 2: "clean", 3: ""}


def test_query(spark):
    rows = {r.doc_id: r for r in pii.op11_personal_data(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        spans, got = base_spans(r.text or ""), rows[r.doc_id]
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [sum(s[0] == k for s in spans) for k in range(4)]
        assert got.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_odd_rows(odd, empty, model):
    rows = pii.find_personal_data(odd, model).collect()
    assert len(rows) == odd.count() and all(not r.more for r in rows)
    assert pii.find_personal_data(empty, model).count() == 0
    # Too long for the plain patterns, which go over each run again from each of its letters.
    long = odd.sparkSession.createDataFrame([(1, "a" * 200_000 + " " + "b.c" * 50_000 + " x@y.zz")], "doc_id long, text string")
    assert [(s.start, s.end) for s in pii.find_personal_data(long, model).collect()[0].base] == [(350_002, 350_008)]
