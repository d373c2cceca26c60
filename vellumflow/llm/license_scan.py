"""License scans by diagonal voting.

All rolling word k-gram hashes of the texts are joined with the positions of the same grams in license templates.
A match votes for the diagonal (text position - template position). Neighbouring diagonals at most SHIFT apart merge into
one run, however many follow on each other; its matches are verified word by word on the text, and it counts with the
share of the template's grams that stand on any of its diagonals. A diagonal on which a whole phrase matches is an exact
place of the phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumflow.llm.common import BROADCAST_BYTES, KEY, Scratch, arrow_map, join_small, keyed
from vellumflow.llm.kernel import ALNUM, Texts, Words, as_signed, prefix, range_hash, slices, windows

GRAM = 3
#: Word insertions or deletions that a span may have between neighbouring matches.
SHIFT = 4
#: Share of a longer template's grams that a span must cover for its label.
COVER = 0.6

# Exact phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Longer notices and their labels; the words are what counts.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "licensed under the gnu general public license version 3": "gpl-3",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
}


def _emit_grams(batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, "text", 1 << 20):
        words = Words(Texts(part["text"]), ALNUM, lower=True)
        at, grams = windows(words, prefix(words.hashes()), k)
        if len(at):
            doc = words.doc[at]
            index = pa.array(doc)
            yield pa.record_batch(
                [pa.array(as_signed(grams)), part["_d"].take(index), part["_t"].take(index), pa.array((at - words.first[doc]).astype(np.int32))],
                ["gram", *KEY, "position"],
            )


def _words_of(text: str) -> Words:
    return Words(Texts(pa.array([text])), ALNUM, lower=True)


def templates(spark, phrases: dict[str, str], notices: dict[str, str], k: int) -> tuple[DataFrame, list[tuple[str, str, bool, int]]]:
    """Positions of all template grams (gram, template, at), and (text, label, is a phrase, grams) of each template."""
    known = [(t, label, True) for t, label in phrases.items()] + [(t, label, False) for t, label in notices.items()]
    rows, out = [], []
    for i, (text, label, base) in enumerate(known):
        words = _words_of(text)
        if len(words) < k:
            raise ValueError(f"a template needs at least {k} words: {text}")
        at, grams = windows(words, prefix(words.hashes()), k)
        rows += [(int(g), i, int(a)) for g, a in zip(as_signed(grams), at, strict=True)]
        out.append((text, label, base, len(at)))
    return spark.createDataFrame(rows, "gram long, template int, at int"), out


def _verify(batch: pa.RecordBatch, known: list[tuple[str, str, bool, int]], k: int, cover: float) -> Iterator[pa.RecordBatch]:
    """Reads each row's spans on its words; per row: exact places of phrases, labels and score."""
    reference = []
    for text, *_ in known:
        w = _words_of(text)
        reference.append([w.word(i) for i in range(len(w))])
    for part in slices(batch, "text"):
        words = Words(Texts(part["text"]), ALNUM, lower=True)
        rows = []
        for doc, spans in enumerate(part["spans"].to_pylist()):
            first, end = int(words.first[doc]), int(words.first[doc + 1])
            places, base, labels, score = set(), set(), set(), 0.0
            for span in spans:
                text = reference[span["template"]]
                _, label, phrase, n_grams = known[span["template"]]
                hit = np.zeros(n_grams, bool)
                for d, ats in zip(span["diagonals"], span["ats"], strict=True):
                    for at in ats:
                        low = first + d + at
                        if low >= first and low + k <= end and [words.word(low + j) for j in range(k)] == text[at : at + k]:
                            hit[at] = True
                covered = float(hit.mean())
                if phrase:
                    if hit.all() and len(span["diagonals"]) == 1:
                        places.add((span["template"], span["diagonals"][0]))
                        base.add(label)
                        labels.add(label)
                        score = 1.0
                elif covered >= cover:
                    labels.add(label)
                    score = max(score, covered)
            starts = [d for _, d in places]
            rows.append((len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        yield pa.RecordBatch.from_arrays(
            [part["_d"], part["_t"], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
            [*KEY, "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        )


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, k: int = GRAM, cover: float = COVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License phrases and notices in every row.

    Returns a row for each row of docs: doc_id, n_words, n_base (exact places of phrases), first_word, last_word
    (smallest and largest start, null without places), base_labels, labels (sorted, comma-joined), score (largest
    covered share of a template whose label counts) and the row key _d, _t.

    Words are runs of digits, a-z (after lower-casing A-Z) and non-ASCII characters. Null or empty text has no words,
    no labels and score 0. Equal rows get equal results. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = keyed(docs, id_col, text_col)
    positions, known = templates(spark, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices, k)
    n_positions = sum(n for *_, n in known)
    grams = arrow_map(rows.select("text", *KEY), lambda b: _emit_grams(b, k), "gram long, _d long, _t long, position int")
    votes = grams.join(F.broadcast(positions) if n_positions * 16 <= BROADCAST_BYTES else positions, "gram")
    # The set of template positions that vote for a diagonal; equal rows vote for the same.
    diagonals = votes.groupBy(*KEY, "template", (F.col("position") - F.col("at")).alias("d")).agg(F.collect_set("at").alias("ats"))
    names = F.array(*(F.lit(base) for *_, base, _ in known))
    own = Window.partitionBy(*KEY, "template").orderBy("d")
    apart = F.col("phrase") | (F.col("d") - F.lag("d").over(own) > SHIFT) | F.lag("d").over(own).isNull()
    merged = diagonals.withColumn("phrase", F.get(names, F.col("template"))).withColumn("new", F.when(apart, 1).otherwise(0))
    merged = merged.withColumn("run", F.sum("new").over(own)).groupBy(*KEY, "template", "phrase", "run")
    merged = merged.agg(F.sort_array(F.collect_list(F.struct("d", "ats"))).alias("parts"))
    total = F.get(F.array(*(F.lit(n) for *_, n in known)), F.col("template"))
    covered = F.size(F.array_distinct(F.flatten("parts.ats")))
    likely = merged.where(F.when(F.col("phrase"), covered == total).otherwise(covered >= cover * total))
    spans = likely.groupBy(*KEY).agg(F.collect_list(F.struct("template", F.col("parts.d").alias("diagonals"), F.col("parts.ats").alias("ats"))).alias("spans"))
    spans = scratch.store(spans, "spans")
    found = join_small(rows.select("text", *KEY), spans, KEY, "inner", 400)
    found = arrow_map(found.select("text", *KEY, "spans"), lambda b: _verify(b, known, k, cover), "_d long, _t long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    found = scratch.store(found.dropDuplicates(KEY), "found")
    # A-Z count as letters of words here; lower-casing joins them to a-z.
    n_words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    counted = rows.select("doc_id", F.coalesce(n_words, F.lit(0)).cast("long").alias("n_words"), *KEY)
    out = join_small(counted, found, KEY, "left", 200)
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    filled = [F.coalesce(c, none[c]).alias(c) if c in none else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")]
    return out.select("doc_id", "n_words", *filled, *KEY)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop(*KEY)

