"""Terms of vocabularies as spans of a text.

Aliases are a table (vocabulary, label, place, alias) of any size. They go round in parts of bounded size, each as one automaton
that finds all its aliases in one pass over a text; what matches as whole words are candidates. Then candidates that lie in
one piece of the text (all of it, the title, a sentence, a clause) are chosen longest first, equal ones from the left, so that
no alias counts inside a longer one. Texts without a candidate are not cut into pieces.

Texts and aliases are compared case-folded; positions are code points of the text as it is, ends exclusive.
"""

from __future__ import annotations

import re
import uuid
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterable
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of aliases in one part; an automaton needs some tens of bytes for each.
PART_CHARS = 1 << 20
# Phrases that mark related work; borders of sentences and clauses; the length of a statement.
RELATED_WORK = ("prior work", "previous work", "related work", "earlier work", "other studies")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
CLAUSE_END = re.compile(r"[;\n]+|\s*,?\s+\b(?:but|however|whereas)\b\s*", re.IGNORECASE)
STATEMENT = 240

Span = tuple[int, int, int]
Entry = tuple[str, str, int, str]
TERM = "vocabulary string, label string, place int, start int, end int"
#: used: whether the span counts as a value of the paper; statement: the evidence, at one span of each value.
FEATURE_TERM = f"{TERM}, used boolean, statement string"
#: Rows whose terms are Python objects at one time.
SLICE_ROWS = 256
WHOLE, TITLE, BODY = range(3)


def alias_table(spark: SparkSession, vocabularies: dict[str, dict[str, list[str]]]) -> DataFrame:
    """Vocabularies (label: aliases) as a table; place is a label's place in its vocabulary."""
    rows = [(name, label, i, a) for name, labels in vocabularies.items() for i, (label, aliases) in enumerate(labels.items()) for a in aliases]
    return spark.createDataFrame(rows, "vocabulary string, label string, place int, alias string")


def folded(text: str) -> tuple[str, list[int] | None]:
    """The case-folded text and, where a letter folds to several, each folded letter's place in the text."""
    whole = text.casefold()
    if len(whole) == len(text):
        return whole, None
    return whole, [i for i, c in enumerate(text) for _ in c.casefold()] + [len(text)]


def _wordlike(text: str, i: int) -> bool:
    return 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")


class Matcher:
    """All aliases of a part in one automaton."""

    def __init__(self, entries: list[Entry]):
        self.entries = entries
        by_alias: dict[str, list[int]] = {}
        for i, (_, _, _, alias) in enumerate(entries):
            by_alias.setdefault(alias.casefold(), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for alias, some in by_alias.items():
            if alias:
                self.automaton.add_word(alias, (len(alias), some))
        if len(self.automaton):
            self.automaton.make_automaton()

    def spans(self, text: str) -> list[Span]:
        """(start, end, entry) of every alias that stands as whole words."""
        if not len(self.automaton) or not text:
            return []
        whole, places = folded(text)
        out = []
        for last, (size, some) in self.automaton.iter(whole):
            start, end = last + 1 - size, last + 1
            if not _wordlike(whole, start - 1) and not _wordlike(whole, end):
                # A letter that an alias holds only a part of is no match.
                if places is not None and (start and places[start] == places[start - 1] or places[end] == places[end - 1]):
                    continue
                a, b = (start, end) if places is None else (places[start], places[end])
                out += [(a, b, i) for i in some]
        return out


def longest_first(spans: Iterable[tuple]) -> list[tuple]:
    """Of spans (start, end, ...) those that overlap none chosen before, longest first, then from the left; in order of start."""
    starts: list[int] = []
    chosen: list[tuple] = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], *s)):
        i = bisect_right(starts, s[0])
        if (i == 0 or chosen[i - 1][1] <= s[0]) and (i == len(chosen) or s[1] <= chosen[i][0]):
            starts.insert(i, s[0])
            chosen.insert(i, s)
    return chosen


def _cut(text: str, border: re.Pattern, low: int, high: int) -> list[tuple[int, int]]:
    out, at = [], low
    for m in border.finditer(text, low, high):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, high)]


def sentence_spans(text: str) -> list[tuple[int, int]]:
    return _cut(text, SENTENCE_END, 0, len(text))


def clause_spans(text: str) -> list[tuple[int, int]]:
    """Clauses of all sentences. A clause border is looked for inside its sentence."""
    out = []
    for a, b in sentence_spans(text):
        out += [(a + x, a + y) for x, y in _cut(text[a:b], CLAUSE_END, 0, b - a)]
    return out


def within(spans: Iterable[tuple], pieces: list[tuple[int, int]]) -> dict[int, list[tuple]]:
    """The spans that lie in one piece, by the piece's number; pieces are ascending and disjoint."""
    starts = [a for a, _ in pieces]
    out: dict[int, list[tuple]] = {}
    for s in spans:
        i = bisect_right(starts, s[0]) - 1
        if i >= 0 and s[1] <= pieces[i][1]:
            out.setdefault(i, []).append(s)
    return out


def squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def squeezed_lines(text: str) -> str:
    return re.sub(r"[^\S\n]+", " ", text).strip()


def statement(text: str) -> str:
    clean = squeezed(text)
    return clean if len(clean) <= STATEMENT else clean[: STATEMENT - 3].rstrip() + "..."


def _parts(aliases: DataFrame) -> list[list[Entry]]:
    """The aliases in parts of PART_CHARS characters or less. One alias of a vocabulary is the label's that comes first."""
    rows = aliases.where("alias <> ''").groupBy("vocabulary", "alias").agg(F.min(F.struct("place", "label")).alias("x"))
    rows = rows.select("vocabulary", "x.label", "x.place", "alias").orderBy("vocabulary", "place", "alias")
    parts: list[list[Entry]] = []
    room = 0
    for r in rows.toLocalIterator():
        if not parts or room < len(r.alias):
            parts.append([])
            room = PART_CHARS
        parts[-1].append(tuple(r))
        room -= len(r.alias)
    return parts


#: Automata that a worker has built, by the name of their part; the oldest goes when there are more than MOST_BUILT.
BUILT: dict[str, Matcher] = {}
MOST_BUILT = 4


def _matcher(name: str, sent: Broadcast) -> Matcher:
    if name not in BUILT:
        while len(BUILT) >= MOST_BUILT:
            BUILT.pop(next(iter(BUILT)))
        BUILT[name] = Matcher(sent.value)
    return BUILT[name]


def _candidates(texts: list[pa.Array], sent: list[tuple[str, Broadcast]], texts_of: Callable[..., list[str]]) -> np.ndarray:
    """Row, layer, start, end and entry of all candidates of a batch, by row; entries are numbered through all parts. One row's texts are read at a time."""
    out, first = array("i"), 0
    for name, part in sent:
        matcher = _matcher(name, part)
        for row in range(len(texts[0])):
            before, spans = None, []
            for layer, text in enumerate(texts_of(*(t[row].as_py() for t in texts))):
                # Layers of one text are read once.
                if text != before:
                    before, spans = text, matcher.spans(text)
                for a, b, i in spans:
                    out.extend((row, layer, a, b, first + i))
        first += len(part.value)
    found = np.frombuffer(out, np.int32).reshape(-1, 5)
    return found[np.argsort(found[:, 0], kind="stable")]


def _told(spark: SparkSession, aliases: DataFrame, texts_of: Callable[..., list[str]], columns: list[Column], choose: Callable[..., list[tuple]], fields: str) -> Column:
    """What choose() makes of each row's texts and candidates (layer, start, end, entry); rows without candidates have none.

    Candidates stay in the task, as numbers, and what is chosen becomes Arrow columns SLICE_ROWS rows at a time, so that a worker
    holds no objects for each term of a batch.
    """
    sent = [(uuid.uuid4().hex, spark.sparkContext.broadcast(part)) for part in _parts(aliases) or [[]]]
    names = [x.split() for x in fields.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    n = len(columns)

    @F.arrow_udf(f"array<struct<{fields}>>")
    def find(rows: pa.Array) -> pa.Array:
        texts = [pc.struct_field(rows, i) for i in range(n)]
        entries = list(chain.from_iterable(part.value for _, part in sent))
        found = _candidates(texts, sent, texts_of)
        borders = np.searchsorted(found[:, 0], np.arange(len(rows) + 1))
        out = []
        for low in range(0, len(rows), SLICE_ROWS):
            told, offsets = [], [0]
            for row in range(low, min(low + SLICE_ROWS, len(rows))):
                a, b = borders[row], borders[row + 1]
                if a < b:
                    some = [(layer, x, y, entries[i]) for _, layer, x, y, i in found[a:b].tolist()]
                    told += choose(*(t[row].as_py() for t in texts), some)
                offsets.append(len(told))
            parts = [pa.array([x[i] for x in told], kinds[kind]) for i, (_, kind) in enumerate(names)]
            out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, [name for name, _ in names])))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([(name, kinds[kind]) for name, kind in names])))

    return find(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))))


def with_terms(docs: DataFrame, aliases: DataFrame, text: str = "text", out: str = "terms") -> DataFrame:
    """docs with the terms of their text: vocabulary, label, place, start, end; each vocabulary is matched for itself.

    A null text has no terms; of an alias that two labels of a vocabulary have the first one counts; empty aliases match
    nothing.
    """

    def choose(_: str, found: list[tuple]) -> list[tuple]:
        return [(v, label, place, a, b) for v, a, b, label, place in _chosen(found, WHOLE)]

    return docs.withColumn(out, _told(docs.sparkSession, aliases, _only, [F.coalesce(F.col(text), F.lit(""))], choose, TERM))


def _only(text: str) -> list[str]:
    return [text]


def _by_vocabulary(found: Iterable[tuple], layer: int) -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {}
    for own, start, end, (vocabulary, label, place, _) in found:
        if own == layer:
            out.setdefault(vocabulary, []).append((start, end, label, place))
    return out


def _chosen(found: Iterable[tuple], layer: int) -> list[tuple]:
    """(vocabulary, start, end, label, place), each vocabulary longest first."""
    return [(v, *s) for v, spans in sorted(_by_vocabulary(found, layer).items()) for s in longest_first(spans)]


def _layers(title: str, body: str) -> list[str]:
    """The whole text as it is, the title and the body with single blanks."""
    return [f"{title}\n{body}", squeezed(title), squeezed_lines(body)]


def _feature_terms(title: str, body: str, found: list[tuple], usage: frozenset[str]) -> list[tuple]:
    whole, titled, inner = (_by_vocabulary(found, layer) for layer in (WHOLE, TITLE, BODY))
    clean = squeezed_lines(body)
    sentences = sentence_spans(clean)
    own = [(a, b) for a, b in clause_spans(clean) if not any(m in clean[a:b].casefold() for m in RELATED_WORK)]
    out = []
    for vocabulary in sorted({*whole, *inner, *titled}):
        pieces = own if vocabulary in usage else sentences
        inside = within(inner.get(vocabulary, []), pieces)
        chosen = [(i, *s) for i in sorted(inside) for s in longest_first(inside[i])]
        if vocabulary in usage:
            # Values come from the title and the own clauses.
            head = longest_first(s for s in whole.get(vocabulary, []) if s[1] <= len(title))
            values = [*head, *((s[1], s[2], s[3], s[4]) for s in chosen)]
        else:
            values = longest_first(whole.get(vocabulary, []))
        first: dict[str, str] = {}
        for s in longest_first(titled.get(vocabulary, [])):
            first.setdefault(s[2], statement(title))
        for i, _, _, label, _ in chosen:
            first.setdefault(label, statement(clean[pieces[i][0] : pieces[i][1]]))
        for a, b, label, place in values:
            out.append((vocabulary, label, place, a, b, True, first.pop(label, None) or None))
    return out


def with_feature_terms(papers: DataFrame, aliases: DataFrame, usage: Iterable[str], title: str, body: str, out: str) -> DataFrame:
    """papers with the terms that are their values, and their evidence.

    Vocabularies in `usage` count in the title and in clauses without a mark of related work, with positions in the title or
    in the body with single blanks; others count in the whole text (title, line end, body). A value's evidence is the title, else
    the first such clause, or sentence, that holds it.
    """
    usage = frozenset(usage)
    columns = [F.coalesce(F.col(c), F.lit("")) for c in (title, body)]

    def choose(title: str, body: str, found: list[tuple]) -> list[tuple]:
        return _feature_terms(title, body, found, usage)

    return papers.withColumn(out, _told(papers.sparkSession, aliases, _layers, columns, choose, FEATURE_TERM))
