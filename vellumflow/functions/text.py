"""Column functions on text, ids and URLs. All run in the JVM; patterns use Unicode classes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence and clause borders, URLs, trusted hosts, the mark of omitted text.
SENTENCE_END = r"(?U)(?<=[.!?])\s+"
SENTENCE_END_TIGHT = r"(?U)(?<=[.!?])(?:\s+|(?=[A-Z]))"
CLAUSE_END = r"(?iU)(?:[;\n]+|\s*,?\s+\b(?:but|however|whereas)\b\s*)"
NOT_ONLY = r"(?iU)\bnot only\b.+\bbut (?:also|even)\b"
URL = r"(?iU)https?://[^\s<>\])}]+"
CODE_HOSTS = ("github.com", "gitlab.com", "huggingface.co")
OMISSION = "\n\n[... middle omitted for prompt budget ...]\n\n"
STRINGS = "array<string>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_strings() -> Column:
    return F.array().cast(STRINGS)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for each row, also where f reads it in lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def squeeze(c: Column | str) -> Column:
    """Outer white space off, inner runs to one space."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def squeeze_but_newlines(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)[^\S\n]+", " "), r"(?U)^\s+|\s+$", "")


def fold(c: Column | str) -> Column:
    """Lower case. Unlike full case folding it keeps letters such as sharp s; the library's own lists are free of them."""
    return F.lower(col(c))


@lru_cache(maxsize=1)
def _accented() -> tuple[str, str]:
    """Letters below U+2000 that are one plain letter and marks, and these plain letters."""
    plain = {}
    for i in range(0x80, 0x2000):
        left = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if len(left) == 1 and left != chr(i):
            plain[chr(i)] = left
    return "".join(plain), "".join(plain.values())


def without_accents(c: Column | str) -> Column:
    """Letters without their marks, where one letter is left."""
    return F.translate(F.regexp_replace(col(c), r"\p{Mn}+", ""), *_accented())


def firsts(values: Column, key: Callable[[Column], Column]) -> Column:
    """Of values with one key the first, in order. Sorted by key once, so that only neighbours are compared."""
    placed = F.transform(values, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"), v.alias("v")))
    new = lambda every: F.filter(every, lambda x, j: (j == 0) | ~F.get(every, j - 1)["k"].eqNullSafe(x["k"]))
    kept = once(F.sort_array(placed), new)
    return F.transform(F.sort_array(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))), lambda x: x["v"])


def distinct_folded(values: Column) -> Column:
    """The first spelling of each value, compared without case."""
    return firsts(F.coalesce(values, empty_strings()), fold)


def running_sums(values: Column) -> Column:
    """The sum up to each place. With each round a place takes in what stands twice as far before it, so rounds are as many as the length has bits."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def step(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= back, x + F.get(acc, i - back)).otherwise(x))

    return F.aggregate(rounds, values, step)


def placed_pieces(text: Column, border: str) -> Column:
    """(value, start) of the pieces between borders."""
    pieces, borders = F.split(text, border, -1), F.regexp_extract_all(text, F.lit(border), F.lit(0))
    sizes = F.zip_with(pieces, borders, lambda p, b: F.length(p) + F.coalesce(F.length(b), F.lit(0)))
    placed = lambda n: F.transform(F.arrays_zip(pieces.alias("p"), n.alias("n"), running_sums(n).alias("e")), lambda x: F.struct(x["p"].alias("value"), (x["e"] - x["n"]).alias("start")))
    return once(sizes, placed)


def placed_matches(text: Column, pattern: str, group: int = 0) -> Column:
    """(value, start) of all matches. A group other than 0 has to end where its match ends."""
    whole, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole, lambda g, m: F.length(g) + F.length(m))
    found = lambda ends: F.zip_with(values, ends, lambda v, e: F.struct(v.alias("value"), (e - F.length(v)).alias("start")))
    return F.when(F.size(whole) > 0, once(sizes, lambda n: found(running_sums(n)))).otherwise(F.array().cast("array<struct<value:string,start:int>>"))


def tidy(values: Column) -> Column:
    """Values squeezed, stripped of outer blanks, commas, colons and semicolons, without empty and repeated ones."""
    clean = F.transform(values, lambda v: F.regexp_replace(squeeze(v), r"^[ ,;:]+|[ ,;:]+$", ""))
    return distinct_folded(F.filter(clean, lambda v: v != ""))


def sentences(c: Column | str) -> Column:
    return F.split(col(c), SENTENCE_END)


def tight_sentences(c: Column | str) -> Column:
    """Also cuts where a capital follows a full stop at once."""
    return F.split(col(c), SENTENCE_END_TIGHT)


def clauses(sentence: Column) -> Column:
    return F.split(sentence, CLAUSE_END)


def claim_clauses(sentence: Column) -> Column:
    """Clauses, but a sentence with `not only ... but also` stays whole."""
    return F.when(sentence.rlike(NOT_ONLY), F.array(sentence)).otherwise(clauses(sentence))


def first_sentence(c: Column | str) -> Column:
    clean = squeeze(c)
    first = F.get(F.split(clean, SENTENCE_END, 2), F.lit(0))
    return F.when(first != "", first).otherwise(F.substring(clean, 1, 240))


def short_statement(c: Column | str) -> Column:
    """At most 240 characters; longer text ends in three dots."""
    clean = squeeze(c)
    return F.when(F.length(clean) <= 240, clean).otherwise(F.concat(F.regexp_replace(F.substring(clean, 1, 237), r"(?U)\s+$", ""), F.lit("...")))


def contains_any(c: Column, markers: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [fold(c).contains(m) for m in markers])


def marked_statements(c: Column | str, markers: tuple[str, ...], unless: str | None = None) -> Column:
    """Sentences with a marker, shortened, each once; those matching `unless` are left out."""
    found = F.filter(sentences(squeeze(c)), lambda s: contains_any(s, markers) & (~s.rlike(unless) if unless else F.lit(True)))
    return distinct_folded(F.transform(found, short_statement))


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and final dot; null for what isn't a URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"\.$", "")


def trusted(host: Column, hosts: tuple[str, ...] = CODE_HOSTS) -> Column:
    ok = reduce(lambda a, b: a | b, [(host == h) | host.endswith(f".{h}") for h in hosts])
    return F.coalesce(ok, F.lit(False))


def code_urls(c: Column | str, hosts: tuple[str, ...] = CODE_HOSTS) -> Column:
    """Distinct URLs of trusted hosts in order; a malformed URL is no URL (it doesn't fail the row)."""
    found = F.transform(F.regexp_extract_all(col(c), F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;]+$", ""))
    return F.array_distinct(F.filter(found, lambda u: trusted(url_host(u), hosts)))


def split_version(c: Column | str) -> Column:
    """(base, version) of an id or abstract URL; without a version suffix it is 1."""
    clean = F.regexp_replace(F.trim(col(c)), r"^.*arxiv\.org/abs/", "")
    version = F.regexp_extract(clean, r"(?i)v(\d+)$", 1)
    return F.struct(F.regexp_replace(clean, r"(?i)v\d+$", "").alias("base"), F.when(version == "", 1).otherwise(F.try_to_number(version, F.lit("999999999")).cast("int")).alias("version"))


def feed_id(c: Column | str) -> Column:
    """(versioned, base) as feed entries are named: after the last slash, and before the first v."""
    last = F.element_at(F.split(col(c), "/"), -1)
    return F.struct(last.alias("versioned"), F.substring_index(last, "v", 1).alias("base"))


def file_name(c: Column | str) -> Column:
    return F.concat(F.replace(col(c), F.lit("/"), F.lit("_")), F.lit(".pdf"))


def node_id(kind: Column, canonical: Column) -> Column:
    return F.concat(F.lower(kind), F.lit(":"), F.substring(F.sha2(canonical, 256), 1, 16))


def valid_date(c: Column | str) -> Column:
    """Is it a date written YYYY-MM-DD."""
    return F.coalesce(col(c).rlike(r"^\d{4}-\d{2}-\d{2}$") & col(c).try_cast("date").isNotNull(), F.lit(False))


def valid_category(c: Column | str) -> Column:
    return col(c).rlike(r"^[A-Za-z]+(?:[.-][A-Za-z]+)+$")


def downloadable(url: Column, head: Column) -> Column:
    """May this be stored as a PDF: an http(s) URL, a host ending in arxiv.org, and a PDF's first bytes."""
    return url.rlike(r"(?i)^https?://") & F.coalesce(url_host(url).endswith("arxiv.org"), F.lit(False)) & head.startswith("%PDF")


def readable_pages(pages: Column) -> Column:
    """Page texts joined under page headings, or null if under 200 characters besides white space came out."""
    joined = F.concat_ws("", F.transform(pages, lambda p, i: F.concat(F.lit("\n=== PAGE "), (i + 1).cast("string"), F.lit(" ===\n"), p)))
    return F.when(F.length(F.regexp_replace(joined, r"(?U)\s+", "")) >= 200, joined)


def n_words(c: Column | str) -> Column:
    clean = squeeze(c)
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " ")))


def head_tail(text: Column, budget: Column) -> Column:
    """Three quarters of what fits from the front and the rest from the back, around the omission mark."""
    mark = len(OMISSION)
    content = budget - mark
    first = F.floor(content * 0.75).cast("int")
    last = content - first
    return F.when(budget <= mark, F.substring(text, F.lit(1), budget)).otherwise(F.concat(F.substring(text, F.lit(1), first), F.lit(OMISSION), F.substring(text, F.length(text) - last + 1, last)))
