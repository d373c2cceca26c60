"""Extraction over whole documents: terms as spans, features with their evidence, claims with their details.

The driver's documents are invented words, so that besides the five vocabularies each passage of `benchmark` gives three
aliases that overlap each other; documents hold such passages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumflow.operators.claims import claim_spans, with_claims
from vellumflow.operators.features import VOCABULARIES, aliases_of, with_features
from vellumflow.operators.spans import with_terms
from vellumflow.plans.registry import query, table

# First word and number of words of a passage's aliases.
CUTS = ((1, 3), (2, 5), (2, 2))
NAMES = list(VOCABULARIES)


def benchmark_aliases(spark, sf_dir):
    """Aliases of each passage, for one of the five vocabularies."""
    words = F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))
    cut = lambda a, n: F.regexp_replace(F.array_join(F.slice(words, a, n), " "), "[.,]+$", "")
    aliases = F.explode(F.array(*(cut(a, n) for a, n in CUTS)))
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.pmod("item_id", F.lit(len(NAMES))) + 1).cast("int"))
    rows = table(spark, sf_dir, "benchmark").select(name.alias("vocabulary"), F.concat(F.lit("B"), "item_id").alias("label"), (F.col("item_id") + 1000).cast("int").alias("place"), aliases.alias("alias"))
    return rows.where("alias <> ''")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_GIVEN = ", ".join(f"({_sql_text(v)}, {_sql_text(label)}, {i}, {_sql_text(a)})" for v, labels in VOCABULARIES.items() for i, (label, some) in enumerate(labels.items()) for a in some)
_CUT_SQL = ", ".join(f"regexp_replace(array_to_string(w[{a}:{a + n - 1}], ' '), '[.,]+$', '')" for a, n in CUTS)
_ALIASES = rf"""
    alias0 AS (
        SELECT * FROM (VALUES {_GIVEN}) v(vocabulary, label, place, alias)
        UNION ALL
        SELECT [{", ".join(map(_sql_text, NAMES))}][item_id % {len(NAMES)} + 1], 'B' || item_id, item_id + 1000, unnest([{_CUT_SQL}])
        FROM (SELECT item_id, regexp_extract_all(text, '[^ \n]+') AS w FROM benchmark)
    ),
    alias AS (SELECT vocabulary, lower(alias) AS alias, min(place) AS place, arg_min(label, place) AS label FROM alias0 WHERE alias <> '' GROUP BY ALL)
"""
_WORD = r"[\p{L}\p{N}_]"
# From pieces (doc_id, layer, i, t) to chosen terms (doc_id, layer, i, vocabulary, x: start, end, label, place), each longest first.
_CHOSEN = rf"""
    near AS (SELECT doc_id, layer, i, lower(t) AS t, a.* FROM piece JOIN alias a ON contains(lower(t), alias)),
    bit AS (SELECT * EXCLUDE (t), string_split(t, alias) AS p FROM near),
    place AS (SELECT * EXCLUDE (p), unnest(p) AS p, unnest(range(1, len(p) + 1)) AS k, len(p) AS m FROM bit),
    met AS (
        SELECT *, sum(length(p)) OVER w + (k - 1) * length(alias) AS s, lead(p) OVER w AS q FROM place
        WINDOW w AS (PARTITION BY doc_id, layer, i, vocabulary, alias ORDER BY k)
    ),
    cand AS (
        SELECT doc_id, layer, i, vocabulary, {{'s': s::INTEGER, 'e': (s + length(alias))::INTEGER, 'label': label, 'place': place}} AS x FROM met
        WHERE k < m AND NOT regexp_matches(CASE WHEN p = '' AND k > 1 THEN alias ELSE p END, '{_WORD}$')
            AND NOT regexp_matches(CASE WHEN q = '' AND k + 1 < m THEN alias ELSE q END, '^{_WORD}')
    ),
    listed AS (SELECT doc_id, layer, i, vocabulary, list(x ORDER BY x.e - x.s DESC, x.s) AS l FROM cand GROUP BY ALL),
    chosen AS (
        SELECT doc_id, layer, i, vocabulary, unnest(list_reduce(
            l, lambda acc, y: CASE WHEN len(list_filter(acc, lambda z: z.s < y.e AND y.s < z.e)) > 0 THEN acc ELSE list_concat(acc, [y]) END, []
        )) AS x FROM listed
    )
"""


@query(
    f"""
    WITH {_ALIASES}, piece AS (SELECT doc_id, 'whole' AS layer, 0 AS i, coalesce(text, '') AS t FROM documents), {_CHOSEN}
    SELECT doc_id, vocabulary, x.label AS label, x.s AS start_at, x.e AS end_at FROM chosen
    """
)
def document_terms(spark, sf_dir):
    """Every term of every document, by position."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_terms(docs, aliases_of(docs, benchmark_aliases(spark, sf_dir)))
    return found.select("doc_id", F.explode("terms").alias("x")).select("doc_id", "x.vocabulary", "x.label", F.col("x.start").alias("start_at"), F.col("x.end").alias("end_at"))


# Title: the first line. Abstract: the whole text. The body is the abstract, a line end and an empty paper text.
_PIECES = r"""
    doc AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, trim(regexp_replace(text, '[^\S\n]+', ' ', 'g'), ' ' || chr(10)) AS body, text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
    sentence AS (SELECT doc_id, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM doc)),
    clause AS (
        SELECT doc_id, i * 10000 + unnest(range(1, len(l) + 1)) AS i, unnest(l) AS t
        FROM (SELECT doc_id, i, string_split(regexp_replace(t, '(?i)([;\n]+|\s*,?\s+\b(but|however|whereas)\b\s*)', chr(1), 'g'), chr(1)) AS l FROM sentence)
    ),
    piece AS (
        SELECT doc_id, 'whole' AS layer, 0 AS i, title || chr(10) || text || chr(10) AS t FROM doc
        UNION ALL SELECT doc_id, 'raw title', 0, title FROM doc
        UNION ALL SELECT doc_id, 'title', 0, trim(regexp_replace(title, '\s+', ' ', 'g')) FROM doc
        UNION ALL SELECT doc_id, 'sentence', i, t FROM sentence
        UNION ALL SELECT doc_id, 'clause', i, t FROM clause WHERE NOT regexp_matches(lower(t), '(prior|previous|related|earlier) work|other studies')
    )
"""
FEATURES_SQL = f"""
    WITH {_ALIASES}, {_PIECES}, {_CHOSEN},
    usage AS (SELECT *, vocabulary IN ('methods', 'datasets', 'metrics') AS use FROM chosen),
    value AS (SELECT DISTINCT doc_id, vocabulary, x.label AS label, x.place AS place FROM usage WHERE CASE WHEN use THEN layer IN ('raw title', 'clause') ELSE layer = 'whole' END),
    first AS (
        SELECT doc_id, vocabulary, x.label AS label, min({{'o': CASE WHEN layer = 'title' THEN 0 ELSE 1 END, 'i': i, 'layer': layer}}) AS f FROM usage
        WHERE layer = 'title' OR layer = CASE WHEN use THEN 'clause' ELSE 'sentence' END GROUP BY ALL
    ),
    said AS (
        SELECT first.*, trim(regexp_replace(t, '\s+', ' ', 'g')) AS s FROM first JOIN piece ON piece.doc_id = first.doc_id AND piece.layer = f.layer AND piece.i = f.i
    ),
    shown AS (
        SELECT value.*, list_position({NAMES}, vocabulary) AS field_at, CASE WHEN s IS NULL OR length(s) <= 240 THEN s ELSE rtrim(s[1:237]) || '...' END AS statement
        FROM value LEFT JOIN said USING (doc_id, vocabulary, label)
    )
"""
_LISTS = ", ".join(f"coalesce(string_agg(label, '|' ORDER BY place) FILTER (WHERE vocabulary = '{v}'), '') AS {v}" for v in NAMES)


def _documents(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.substring_index(text, "\n", 1).alias("title"), text.alias("abstract"), F.lit(None).cast("string").alias("paper_text"))


def featured(spark, sf_dir):
    return with_features(_documents(spark, sf_dir), aliases=benchmark_aliases(spark, sf_dir))


@query(f"{FEATURES_SQL} SELECT documents.doc_id, {_LISTS} FROM documents LEFT JOIN shown USING (doc_id) GROUP BY documents.doc_id")
def document_features(spark, sf_dir):
    """The values of every field of every document."""
    f = F.col("features")
    return featured(spark, sf_dir).select("doc_id", *(F.concat_ws("|", f[v]).alias(v) for v in NAMES))


@query(f"{FEATURES_SQL} SELECT doc_id, vocabulary AS field, label AS value, statement FROM shown WHERE statement <> ''")
def document_evidence(spark, sf_dir):
    """The evidence of every value: the title, or the first sentence or own clause that holds it."""
    rows = featured(spark, sf_dir).select("doc_id", F.explode("features.evidence").alias("e")).select("doc_id", "e.*")
    return rows.where(F.col("field").isin(*NAMES))


# Claims. Documents hold none, so each abstract begins with sentences made of the document's own columns, of one of six shapes.
SHAPES = (
    "Compared with {source} baselines, we find {a}.{b} percentage points higher accuracy on Set{id} under {lang} noise (p < 0.0{c}).",
    "Our results show that {source} leads to a factor of {a} change within {n} samples.",
    "We observe no improvement in recall on Set{id}, but we report that {lang} text is linked to delay. We observe no improvement in recall on set{id}.",
    "We show that the score predicts {source} with AUROC 0.{b}{c}.",
    "Some words first.We find a plain fact about {source}. A limitation is item {id}.",
    "There is nothing of the kind in {id}.",
)
_PARTS = {"source": "source", "lang": "lang", "id": "doc_id", "n": "n_chars", "a": "doc_id % 9 + 1", "b": "doc_id % 10", "c": "doc_id % 5 + 1"}


def _filled_sql(shape: str) -> str:
    out = _sql_text(shape)
    for k, v in _PARTS.items():
        out = out.replace("{" + k + "}", f"' || ({v}) || '")
    return f"({out})"


def _claimed(spark, sf_dir):
    parts = {k: F.expr(v).cast("string") for k, v in _PARTS.items()}

    def filled(shape: str):
        pieces = [F.lit(x) if i % 2 == 0 else parts[x] for i, x in enumerate(shape.replace("}", "{").split("{"))]
        return F.concat(*pieces)

    shape = F.get(F.array(*map(filled, SHAPES)), F.pmod("doc_id", F.lit(len(SHAPES))).cast("int"))
    docs = table(spark, sf_dir, "documents").withColumns({"lang": F.coalesce("lang", F.lit("xx")), "source": F.coalesce("source", F.lit("none"))})
    return docs.select("doc_id", F.concat(shape, F.lit(" "), F.coalesce("text", F.lit(""))).alias("abstract"))


# For each shape: the claims with sentence, type, direction, details by field, and the number of groups that support them.
_TOLD = {
    0: [(0, SHAPES[0], "comparative", "positive", {"comparators": "{source} baselines", "evaluation_contexts": "Set{id}", "metrics": "accuracy", "reported_values": "{a}.{b} percentage points", "effect_sizes": "{a}.{b} percentage points", "uncertainty": "p < 0.0{c}", "conditions": "under {lang} noise"}, 6)],
    1: [(0, SHAPES[1], "causal_language", "unclear", {"evaluation_contexts": "{n} samples", "reported_values": "factor of {a}", "effect_sizes": "factor of {a}", "conditions": "within {n} samples"}, 3)],
    2: [
        (0, "We observe no improvement in recall on Set{id}", "comparative", "negative", {"evaluation_contexts": "Set{id}", "metrics": "recall"}, 2),
        (0, "we report that {lang} text is linked to delay.", "associational", "unclear", {}, 0),
        (1, "We observe no improvement in recall on set{id}.", "comparative", "negative", {"metrics": "recall"}, 1),
    ],
    3: [(0, SHAPES[3], "predictive", "unclear", {"metrics": "AUROC", "reported_values": "0.{b}{c}"}, 2)],
    4: [(1, "We find a plain fact about {source}.", "descriptive", "unclear", {}, 0)],
}
FIELDS = ["comparators", "evaluation_contexts", "metrics", "reported_values", "effect_sizes", "uncertainty", "conditions"]
_CLAIMS = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS claim_index, {i} AS sentence_index, {_filled_sql(claim)} AS claim, '{kind}' AS claim_type, '{way}' AS direction, "
    + ", ".join(f"{_filled_sql(d[f]) if f in d else _sql_text('')} AS {f}" for f in FIELDS)
    + f", least(0.55::DOUBLE + {n} * 0.05::DOUBLE, 0.9) AS confidence FROM doc WHERE doc_id % {len(SHAPES)} = {shape}"
    for shape, some in _TOLD.items()
    for k, (i, claim, kind, way, d, n) in enumerate(some)
)
_SHAPED = f"""
    doc AS (SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'xx') AS lang, n_chars, coalesce(text, '') AS text FROM documents),
    told AS ({_CLAIMS}),
    abstract AS (
        SELECT doc_id, trim(regexp_replace(CASE doc_id % {len(SHAPES)} {" ".join(f"WHEN {i} THEN {_filled_sql(s)}" for i, s in enumerate(SHAPES))} END || ' ' || text, '\\s+', ' ', 'g')) AS t FROM doc
    )
"""


@query(
    f"""
    WITH {_SHAPED}
    SELECT told.*, CASE WHEN doc_id % {len(SHAPES)} = 4 THEN 'A limitation is item ' || doc_id || '.' ELSE '' END AS paper_level_boundaries, 'abstract' AS evidence_source, claim AS statement FROM told
    """
)
def document_claims(spark, sf_dir):
    """Every field of every claim of every document; texts are read whole."""
    papers = with_claims(_claimed(spark, sf_dir)).select("doc_id", F.posexplode("validity_envelopes").alias("claim_index", "e"))
    lists = [F.concat_ws("|", F.col(f"e.{c}")).alias(c) for c in (*FIELDS, "paper_level_boundaries")]
    return papers.select("doc_id", "claim_index", "e.evidence.sentence_index", "e.claim", "e.claim_type", "e.direction", *lists, "e.confidence", F.col("e.evidence.source").alias("evidence_source"), "e.evidence.statement")


@query(
    f"""
    WITH {_SHAPED},
    part AS (
        SELECT doc_id, claim_index, claim, 'claim' AS kind, claim AS value FROM told
        {" ".join(f"UNION ALL SELECT doc_id, claim_index, claim, '{f}', {f} FROM told WHERE {f} <> ''" for f in FIELDS)}
    )
    SELECT doc_id, claim_index, kind, value, (strpos(t, claim) + strpos(claim, value) - 2)::INTEGER AS start_at, (strpos(t, claim) + strpos(claim, value) - 2 + length(value))::INTEGER AS end_at
    FROM part JOIN abstract USING (doc_id)
    """
)
def claim_places(spark, sf_dir):
    """Claims and their details by position."""
    return claim_spans(_claimed(spark, sf_dir), "doc_id").withColumnsRenamed({"start": "start_at", "end": "end_at"})
