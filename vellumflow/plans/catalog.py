"""Named queries over the driver's tables, with SQL of the same meaning.

The driver's tables are no papers; each query names the columns that stand in for a paper's.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumflow.functions import text as T
from vellumflow.functions.unicode import casefolded
from vellumflow.operators import classifier, curation, hashed, library, metrics, split, terms, upsert
from vellumflow.operators.bucketed import BucketedStore
from vellumflow.operators.claims import CLAIM, with_claims
from vellumflow.operators.features import matched, used
from vellumflow.operators.ranks import ranked
from vellumflow.operators.selection import prompt_text
from vellumflow.plans import extraction, records, streams  # noqa: F401  (they register their queries)
from vellumflow.plans.registry import ORACLE, QUERIES, query, table  # noqa: F401
from vellumflow.schemas import PAPERS
from vellumflow.sources.shards import digests, shard_counts

SENTENCES = r"string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
SQUEEZED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
MARKERS = ("license", "token")


# Library


@query(
    """
    SELECT doc_id, lang, source, n_chars
    FROM (SELECT * FROM documents ORDER BY doc_id DESC LIMIT 500)
    WHERE contains(lower(text), 'license') AND lang = 'en'
    ORDER BY doc_id DESC LIMIT 100
    """
)
def library_page(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("*", F.array("lang", "source").alias("categories"), F.col("text").alias("title"), F.lit("").alias("abstract"), F.array().cast("array<string>").alias("authors"), F.col("doc_id").cast("string").alias("key"))
    page = library.search(docs, "license", "en", 100, by="doc_id", key="key")
    return page.select("doc_id", "lang", "source", "n_chars")


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def newest_rows(spark, sf_dir):
    return library.newest(table(spark, sf_dir, "documents"), 50, "n_chars", "doc_id").select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id = 7")
def point_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "arxiv_id")
    return library.lookup(docs, 7).select(F.col("arxiv_id").alias("doc_id"), "lang", "source")


def _papers_and_features(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    papers = docs.select(F.col("doc_id").alias("arxiv_id"), F.concat(F.lit("v"), F.pmod("doc_id", F.lit(2)).cast("string")).alias("versioned_id"), F.col("n_chars").alias("published_at"))
    features = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("arxiv_id"),
        F.concat(F.lit("v"), F.col("quality").cast("string")).alias("source_versioned_id"),
        F.lit("rules").alias("extractor"),
        F.col("toxic").cast("string").alias("extractor_version"),
        F.lit(None).cast("string").alias("prompt_version"),
        F.lit("").alias("features"),
    )
    return papers, features


@query(
    """
    SELECT d.doc_id AS arxiv_id FROM documents d LEFT JOIN labels l USING (doc_id)
    WHERE l.doc_id IS NULL OR l.quality <> d.doc_id % 2 OR l.toxic <> 0
    ORDER BY n_chars, d.doc_id LIMIT 100
    """
)
def work_list(spark, sf_dir):
    papers, features = _papers_and_features(spark, sf_dir)
    return library.work_list(papers, features, "rules", "0", None, 100).select("arxiv_id")


@query("SELECT d.doc_id AS arxiv_id, 'v' || (d.doc_id % 2) AS versioned_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = d.doc_id % 2")
def fresh_features(spark, sf_dir):
    papers, features = _papers_and_features(spark, sf_dir)
    return library.current_features(papers, features).select("arxiv_id", "versioned_id")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def missing_parents(spark, sf_dir):
    return library.orphans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM pages) AS pages")
def store_counts(spark, sf_dir):
    return library.store_counts(**{n: table(spark, sf_dir, n) for n in ("documents", "labels", "events", "pages")})


@query("SELECT DISTINCT unnest([lang, source]) AS category FROM documents")
def distinct_categories(spark, sf_dir):
    return library.categories(table(spark, sf_dir, "documents").select(F.array("lang", "source").alias("categories")))


# Revisions

_ARRIVALS = """
    WITH s AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events),
    t AS (SELECT event_id, user_id, CASE WHEN last IS NULL THEN 'inserted' WHEN last = event_type THEN 'unchanged' ELSE 'updated' END AS status FROM s)
"""


def _statuses(spark, sf_dir):
    return upsert.statuses(table(spark, sf_dir, "events"), "user_id", ["event_type"], ["ts", "event_id"])


@query(f"{_ARRIVALS} SELECT * FROM t")
def upsert_status(spark, sf_dir):
    return _statuses(spark, sf_dir).select("event_id", "user_id", "status")


@query(f"{_ARRIVALS} SELECT status, count(*) AS n FROM t GROUP BY status")
def upsert_counts(spark, sf_dir):
    return upsert.status_counts(_statuses(spark, sf_dir))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_state(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return upsert.latest(events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT event_id FROM events WHERE date_trunc('minute', ts) BETWEEN TIMESTAMP '2024-01-09 12:00:00' AND TIMESTAMP '2024-01-11 12:00:00' AND event_type IN ('click', 'view', 'purchase')")
def window_overlap(spark, sf_dir):
    from datetime import datetime

    start = upsert.window_start(datetime(2024, 1, 10, 12), datetime(2024, 1, 11, 12))
    events = table(spark, sf_dir, "events").select("event_id", F.array("event_type").alias("categories"), F.col("ts").cast("timestamp").alias("published_at"))
    return upsert.in_window(events, start, datetime(2024, 1, 11, 12), ["click", "view", "purchase"]).select("event_id")


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 100")
def saturated_rows(spark, sf_dir):
    return upsert.capped(table(spark, sf_dir, "events"), 100, ["ts", "event_id"])[0].select("event_id")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-01 12:00:00')")
def unseen_revisions(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("versioned_id", F.col("user_id"))
    return upsert.unseen(events, events.where("ts < timestamp_ntz '2024-01-01 12:00:00'")).select("event_id")


# Curation

_QUOTAS = """
    WITH c AS (SELECT source AS category, count(*) AS n FROM documents GROUP BY source),
    p AS (SELECT count(*) AS g, sum(n) AS total, (sum(n) // 3)::BIGINT AS target FROM c),
    s AS (SELECT category, n, ((target - g)::BIGINT * (n - 1))::DOUBLE / (total - g)::DOUBLE AS share, target - g AS spare FROM c, p),
    w AS (SELECT *, floor(share) AS whole, row_number() OVER (ORDER BY share - floor(share) DESC, category DESC) AS place FROM s),
    q AS (SELECT category, n, (1 + whole + CASE WHEN place <= spare - (SELECT sum(whole) FROM w) THEN 1 ELSE 0 END)::BIGINT AS quota FROM w)
"""


def _named(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("primary_category", F.col("source"))


@query(f"{_QUOTAS} SELECT category, n, quota FROM q")
def category_quotas(spark, sf_dir):
    docs = _named(spark, sf_dir)
    return curation.quotas(docs.groupBy(F.col("source").alias("category")).agg(F.count(F.lit(1)).alias("n")), docs.count() // 3)


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events")
def event_places(spark, sf_dir):
    """The place of every event among those of its type: four groups, none of which one task holds."""
    return ranked(table(spark, sf_dir, "events"), "event_type", [F.col("value").desc_nulls_last(), F.col("event_id").asc()], ["event_id"])


@query(
    f"""{_QUOTAS}
    SELECT doc_id, source FROM (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, sha256(doc_id::VARCHAR) DESC) AS place FROM documents
    ) d JOIN q ON q.category = d.source WHERE place <= quota
    """
)
def curated_docs(spark, sf_dir):
    docs = _named(spark, sf_dir)
    order = [F.col("n_chars"), F.sha2(F.col("doc_id").cast("string"), 256)]
    return curation.curate(docs, docs.count() // 3, order, "doc_id").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE NOT (starts_with(source, 'src1') OR starts_with(source, 'src3'))")
def prefix_exclusion(spark, sf_dir):
    return curation.without_prefixes(table(spark, sf_dir, "documents"), ("src1", "src3"), "source").select("doc_id", "source")


@query(
    """
    SELECT d::DATE AS date, count(event_id) AS paper_count
    FROM generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY) AS g(d) LEFT JOIN events ON ts::DATE = d::DATE
    GROUP BY 1
    """
)
def daily_counts(spark, sf_dir):
    return curation.daily_counts(table(spark, sf_dir, "events"), "2023-12-25", "2024-02-05", "ts")


# Metrics


@query(
    """
    WITH g AS (SELECT doc_id FROM labels WHERE quality = 1), p AS (SELECT doc_id FROM labels WHERE toxic = 1),
    c AS (SELECT count(*) FILTER (WHERE g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS tp, count(*) FILTER (WHERE g.doc_id IS NULL) AS fp,
        count(*) FILTER (WHERE p.doc_id IS NULL) AS fn FROM g FULL JOIN p ON g.doc_id = p.doc_id)
    SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
        2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1 FROM c
    """
)
def set_metrics(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return metrics.set_metrics(labels.where("quality = 1"), labels.where("toxic = 1"), ["doc_id"])


_REPORT = """
    WITH l AS (SELECT quality AS t, toxic AS p FROM labels), names AS (SELECT t AS label FROM l UNION SELECT p FROM l),
    c AS (SELECT label, (SELECT count(*) FROM l WHERE t = label) AS support, (SELECT count(*) FROM l WHERE p = label) AS guessed,
        (SELECT count(*) FROM l WHERE t = label AND p = label) AS hits FROM names),
    r AS (SELECT label, support, CASE WHEN guessed = 0 THEN 0 ELSE hits / guessed END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall FROM c),
    f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r)
"""


@query(f"{_REPORT} SELECT * FROM f")
def class_report(spark, sf_dir):
    return metrics.class_report(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("SELECT quality, toxic, count(*) AS n FROM labels WHERE quality <> toxic GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return metrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY n DESC, label LIMIT 1")
def majority_label(spark, sf_dir):
    return metrics.majority_label(table(spark, sf_dir, "embeddings"), "label")


@query("WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), r AS (SELECT *, sqrt(max(n) OVER () / n) AS w FROM c) SELECT lang, n, w / avg(w) OVER () AS weight FROM r")
def class_weights(spark, sf_dir):
    return metrics.class_weights(table(spark, sf_dir, "documents"), "lang")


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "events").select(((F.pmod(F.col("event_id") * 37, F.lit(101))) / 100).alias("confidence"), F.col("event_type").isin("click", "view").alias("correct"))


_SCORED = "WITH s AS (SELECT (event_id * 37 % 101) / 100 AS c, event_type IN ('click', 'view') AS ok FROM events)"


@query(
    f"""{_SCORED}, b AS (SELECT i / 10 AS lower, (i + 1) / 10 AS upper FROM range(10) t(i))
    SELECT lower, upper, count(*) AS n, avg(ok::INT) AS accuracy, avg(c) AS confidence FROM s JOIN b ON c > lower AND c <= upper GROUP BY 1, 2
    """
)
def calibration(spark, sf_dir):
    return metrics.calibration(_scored(spark, sf_dir), "confidence", "correct")


@query(
    f"""{_SCORED} SELECT t AS threshold, count(*) FILTER (WHERE c >= t) AS kept, (count(*) FILTER (WHERE c >= t)) / count(*) AS coverage,
        (count(*) FILTER (WHERE c >= t AND ok)) / (count(*) FILTER (WHERE c >= t)) AS accuracy
    FROM s, (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) v(t) GROUP BY t
    """
)
def selective(spark, sf_dir):
    return metrics.selective(_scored(spark, sf_dir), "confidence", "correct")


_SIZES = """
    WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
    z AS (SELECT lang, n, greatest(1, round_even(n * 0.15::DOUBLE, 0)::BIGINT) AS test, greatest(1, round_even(n * 0.15::DOUBLE, 0)::BIGINT) AS validation FROM c)
"""


@query(f"{_SIZES} SELECT lang, n, test, validation, n - test - validation AS train FROM z")
def split_sizes(spark, sf_dir):
    return split.split_sizes(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang")


@query(
    f"""{_SIZES} SELECT doc_id, lang, CASE WHEN place <= test THEN 'test' WHEN place <= test + validation THEN 'validation' ELSE 'train' END AS split
    FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS place FROM documents) JOIN z USING (lang)
    """
)
def split_assignment(spark, sf_dir):
    return split.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang")


@query("SELECT doc_id, source FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= 120)")
def rare_classes(spark, sf_dir):
    return split.without_rare(table(spark, sf_dir, "documents"), "lang", 120).select("doc_id", "source")


# Text


@query(f"SELECT doc_id, sha256({SENTENCES.format(SQUEEZED.format('text'))}[1]) AS first_hash FROM documents")
def first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.first_sentence("text"), 256).alias("first_hash"))


@query(f"SELECT doc_id, len({SENTENCES.format('text')})::INT AS n, sha256(array_to_string({SENTENCES.format('text')}, '|')) AS hash FROM documents")
def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences("text")).alias("n"), F.sha2(F.concat_ws("|", T.sentences("text")), 256).alias("hash"))


_SHORT = r"CASE WHEN length({0}) <= 240 THEN {0} ELSE rtrim(substr({0}, 1, 237)) || '...' END"


@query(f"SELECT doc_id, {_SHORT.format(SQUEEZED.format('text'))} AS statement FROM documents")
def short_statement(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.short_statement("text").alias("statement"))


@query(
    f"""
    WITH s AS (SELECT doc_id, {SENTENCES.format(SQUEEZED.format('text'))} AS l FROM documents),
    u AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM s),
    m AS (SELECT doc_id, i, {_SHORT.format('x')} AS x FROM u WHERE contains(lower(x), 'license') OR contains(lower(x), 'token')),
    f AS (SELECT doc_id, x, i, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY i) AS r FROM m)
    SELECT doc_id, string_agg(x, '|' ORDER BY i) AS statements FROM f WHERE r = 1 GROUP BY doc_id
    """
)
def explicit_statements(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", T.marked_statements("text", MARKERS).alias("s"))
    return found.where(F.size("s") > 0).select("doc_id", F.concat_ws("|", "s").alias("statements"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM pages")
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.url_host(F.col("url")).alias("host"))


@query(r"WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM pages) SELECT page_id, host = 'example.com' OR ends_with(host, '.example.com') OR host = 'example.org' OR ends_with(host, '.example.org') AS ok FROM h")
def allow_list(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.trusted(T.url_host(F.col("url")), ("example.com", "example.org")).alias("ok"))


_FRONT = int((400 - len(T.OMISSION)) * 0.75)
_BACK = 400 - len(T.OMISSION) - _FRONT


@query(
    f"""
    SELECT doc_id, sha256(CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, {_FRONT}) || chr(10) || chr(10) || '{T.OMISSION.strip()}' || chr(10) || chr(10)
        || substr(text, length(text) - {_BACK - 1}) END) AS hash FROM documents
    """
)
def head_tail(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.when(F.length("text") <= 400, F.col("text")).otherwise(T.head_tail(F.col("text"), F.lit(400))), 256).alias("hash"))


_SECTION = r"(?im)^\s*(\d+(\.\d+)*\s+)?(method|methodology|experiments|results|limitations|conclusion)s?\s*$"


# A text with section headings would need their slices; documents have none, and one that had would show as null.
@query(
    f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS body, 18 + length(coalesce(source, '')) + length({_SHORT.format(SQUEEZED.format("coalesce(text, '')"))}) AS head FROM documents)
    SELECT doc_id, CASE WHEN body = '' THEN head WHEN head + 17 + length(body) <= 4000 THEN head + 17 + length(body)
        WHEN regexp_matches(body, '{_SECTION}') THEN NULL WHEN head + 26 < 4000 THEN 4000 ELSE head END::INT AS length FROM d
    """
)
def prompts(spark, sf_dir):
    """Prompts of all documents, with the source as title and the short statement as abstract; what is null is empty."""
    title, abstract = (F.coalesce(c, F.lit("")) for c in (F.col("source"), T.short_statement("text")))
    docs = table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), abstract.alias("abstract"), F.col("text").alias("full_text"))
    return prompt_text(docs, 4000).select("doc_id", F.length("prompt").alias("length"))


@query("SELECT doc_id, doc_id::VARCHAR AS base, (doc_id % 5)::INT AS version FROM documents")
def version_split(spark, sf_dir):
    parts = T.split_version(F.concat(F.lit("http://arxiv.org/abs/"), F.col("doc_id").cast("string"), F.lit("v"), F.pmod("doc_id", F.lit(5)).cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", parts["base"].alias("base"), parts["version"].alias("version"))


@query("SELECT doc_id, 'source:' || substr(sha256(source), 1, 16) AS node_id FROM documents")
def node_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.node_id(F.lit("Source"), F.col("source")).alias("node_id"))


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(
    r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents),
    u AS (SELECT doc_id, unnest(t) AS term FROM w),
    c AS (SELECT doc_id, term, count(*) AS n FROM u WHERE term NOT IN (STOP) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, encode(term)) AS place FROM c)
    SELECT doc_id, string_agg(term, '|' ORDER BY place) AS terms FROM r WHERE place <= 12 GROUP BY doc_id
    """.replace("STOP", ", ".join(f"'{w}'" for w in terms.STOP_WORDS))
)
def top_words(spark, sf_dir):
    return terms.top_words(table(spark, sf_dir, "documents"), "doc_id", "text", 12).select("doc_id", F.concat_ws("|", "terms").alias("terms"))


@query(
    r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}'), lambda x: x NOT IN (STOP)) AS t FROM documents),
    u AS (SELECT doc_id, unnest(t) AS term FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM w),
    c AS (SELECT doc_id, term, count(*) AS n FROM u GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, encode(term)) AS place FROM c),
    k AS (SELECT doc_id, string_agg(term, '|' ORDER BY place) AS terms FROM r WHERE place <= 12 GROUP BY doc_id)
    SELECT doc_id, coalesce(terms, '') AS terms FROM documents LEFT JOIN k USING (doc_id)
    """.replace("STOP", ", ".join(f"'{w}'" for w in terms.STOP_WORDS))
)
def keywords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("|", terms.keywords(F.col("text"))).alias("terms"))


@query(
    r"""
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
    c AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term NOT IN (STOP) GROUP BY 1, 2),
    d AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM c GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
    v AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM d, n WHERE df >= 2 AND df <= 0.995 * n ORDER BY cf DESC, encode(term) LIMIT 500),
    x AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS raw FROM c JOIN v USING (term)),
    m AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM x GROUP BY 1)
    SELECT doc_id, term, round(raw / norm, 6) AS weight FROM x JOIN m USING (doc_id)
    """.replace("STOP", ", ".join(f"'{w}'" for w in terms.STOP_WORDS))
)
def tfidf(spark, sf_dir):
    """Weights of the words of whole texts."""
    return hashed.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text", hashed.word_runs(1, 1), 500).select("doc_id", "term", F.round("weight", 6).alias("weight"))


VOCABULARY = {"apache": ["apache license"], "license": ["license"], "token": ["token"], "the": ["the"]}
_WORD = r"(^|[^\p{L}\p{N}_])WORD([^\p{L}\p{N}_]|$)"
_HAS = lambda text, word: f"regexp_matches({text}, '{_WORD.replace('WORD', word)}')"
_APACHE = _WORD.replace("WORD", "apache license")


# Neighbouring matches share a border, so that the longer alias is taken out twice.
@query(
    rf"""
    WITH t AS (SELECT doc_id, lower(text) AS t FROM documents),
    r AS (SELECT doc_id, t, regexp_replace(regexp_replace(t, '{_APACHE}', '\1' || chr(1) || '\2', 'g'), '{_APACHE}', '\1' || chr(1) || '\2', 'g') AS r FROM t)
    SELECT doc_id, concat_ws('|', CASE WHEN {_HAS("t", "apache license")} THEN 'apache' END, CASE WHEN {_HAS("r", "license")} THEN 'license' END,
        CASE WHEN {_HAS("r", "token")} THEN 'token' END, CASE WHEN {_HAS("r", "the")} THEN 'the' END) AS labels FROM r
    """
)
def vocabulary_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("|", matched(F.col("text"), VOCABULARY)).alias("labels"))


_CLAUSES = r"string_split(regexp_replace({}, '(?i)([;\n]+|\s*,?\s+\b(but|however|whereas)\b\s*)', chr(1), 'g'), chr(1))"
_ONE_BLANK = r"regexp_replace(text, '[^\S\n]+', ' ', 'g')"
_RELATED = "lower({0}) NOT LIKE '%prior work%' AND lower({0}) NOT LIKE '%previous work%' AND lower({0}) NOT LIKE '%related work%' AND lower({0}) NOT LIKE '%earlier work%' AND lower({0}) NOT LIKE '%other studies%'"


@query(
    rf"""
    WITH s AS (SELECT doc_id, unnest({SENTENCES.format(_ONE_BLANK)}) AS s FROM documents),
    c AS (SELECT doc_id, unnest({_CLAUSES.format("s")}) AS c FROM s),
    h AS (SELECT doc_id, bool_or({_HAS("lower(c)", "license")}) AS a, bool_or({_HAS("lower(c)", "token")}) AS b FROM c WHERE {_RELATED.format("c")} GROUP BY doc_id)
    SELECT doc_id, concat_ws('|', CASE WHEN a THEN 'license' END, CASE WHEN b THEN 'token' END) AS labels FROM documents LEFT JOIN h USING (doc_id)
    """
)
def usage_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("|", used(F.col("text"), {"license": ["license"], "token": ["token"]})).alias("labels"))


_PLAIN = lambda pattern: pattern.replace("(?iU)", "(?i)")


@query(
    rf"""
    WITH d AS (SELECT doc_id, source, {SQUEEZED.format("CASE WHEN lang = 'en' THEN 'We show that accuracy improves by ' || doc_id || '% on ImageNet. ' || text ELSE text END")} AS t FROM documents),
    m AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), '([.!?])([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM d),
    u AS (SELECT doc_id, unnest(s) AS s FROM m),
    c AS (SELECT doc_id, trim(unnest(CASE WHEN regexp_matches(s, '(?i)\bnot only\b.+\bbut (also|even)\b') THEN [s] ELSE {_CLAUSES.format("s")} END)) AS c FROM u),
    f AS (SELECT doc_id, least(count(DISTINCT lower(c)), 5) AS n FROM c WHERE c <> '' AND {_RELATED.format("c")} AND regexp_matches(c, '{_PLAIN(CLAIM)}') GROUP BY doc_id)
    SELECT source, count(*) AS paper_count, count(n) AS with_envelopes, coalesce(sum(n), 0)::BIGINT AS envelopes FROM documents LEFT JOIN f USING (doc_id) GROUP BY source
    """
)
def claim_status(spark, sf_dir):
    """Claims of whole texts; before each English one is a generated claim with the document's number as the value."""
    planted = F.concat(F.lit("We show that accuracy improves by "), F.col("doc_id").cast("string"), F.lit("% on ImageNet. "), F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("lang") == "en", planted).otherwise(F.col("text")).alias("abstract"))
    return shard_counts(with_claims(docs), "source")


@query("SELECT ts::DATE::VARCHAR AS day, count(*) AS paper_count, count(*) FILTER (WHERE event_type = 'click') AS with_envelopes, count(*) FILTER (WHERE event_type = 'click') AS envelopes FROM events GROUP BY 1")
def shard_manifest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("date").cast("string").alias("day"), F.when(F.col("event_type") == "click", F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("validity_envelopes"))
    return shard_counts(events, "day")


@query(
    """
    WITH r AS (SELECT source, sha256(doc_id || chr(9) || coalesce(text, '')) AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
    c AS (SELECT source, (place - 1) // 50 AS c, sha256(string_agg(h, '' ORDER BY place)) AS d, count(*) AS n FROM r GROUP BY 1, 2)
    SELECT source, sum(n)::BIGINT AS row_count, count(*) AS chunk_count, sha256(string_agg(d, '' ORDER BY c)) AS sha256 FROM c GROUP BY source
    """
)
def document_manifest(spark, sf_dir):
    """Counts and digests of the documents of each source, in chunks of 50."""
    line = F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.coalesce("text", F.lit("")))
    return digests(table(spark, sf_dir, "documents"), "source", [F.col("doc_id")], line, 50)


@query("SELECT doc_id, lang, n_chars FROM (SELECT * FROM documents ORDER BY doc_id DESC LIMIT 500) WHERE contains(replace(lower(text), 'ß', 'ss'), 'ssheit') ORDER BY doc_id DESC LIMIT 100")
def folded_search(spark, sf_dir):
    """A page of what holds a needle with a sharp s, however either is written."""
    docs = table(spark, sf_dir, "documents").select("*", F.array("lang").alias("categories"), F.col("text").alias("title"), F.lit("").alias("abstract"), F.array().cast("array<string>").alias("authors"), F.col("doc_id").cast("string").alias("key"))
    return library.search(docs, "ẞHEIT", "", 100, by="doc_id", key="key").select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, sha256(replace(lower(text), 'ß', 'ss')) AS folded_sha256 FROM documents")
def folded_texts(spark, sf_dir):
    """Whole texts, case-folded."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(casefolded("text"), 256).alias("folded_sha256"))


@query(
    r"""
    WITH w AS (SELECT doc_id, ' ' || unnest(string_split_regex(lower(text), '\s+')) || ' ' AS w FROM documents),
    g AS (SELECT doc_id, substr(w, i, n) AS term FROM (SELECT doc_id, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM w, range(3, 6) s(n) WHERE w <> '  ')),
    c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), d AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM c GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
    v AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM d, n WHERE df >= 2 AND df <= 0.995 * n ORDER BY cf DESC, encode(term) LIMIT 300),
    x AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS raw FROM c JOIN v USING (term)), m AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM x GROUP BY 1)
    SELECT doc_id, term, round(raw / norm, 6) AS weight FROM x JOIN m USING (doc_id)
    """
)
def char_tfidf(spark, sf_dir):
    """Weights of runs of 3 to 5 letters of whole texts, counted as hashes."""
    return hashed.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text", hashed.letter_runs(), 300).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(
    """
    SELECT doc_id AS arxiv_id, CASE WHEN l.doc_id IS NULL THEN 'v' || (d.doc_id % 2) ELSE 'v' || quality END AS source_versioned_id, CASE WHEN l.doc_id IS NULL THEN '1' ELSE '2' END AS extractor_version,
        CASE WHEN l.doc_id IS NULL THEN lang ELSE toxic::VARCHAR END AS features
    FROM documents d FULL JOIN (SELECT * FROM labels UNION ALL SELECT -doc_id, quality, toxic FROM labels WHERE doc_id % 10 = 1) l USING (doc_id)
    """
)
def merged_features(spark, sf_dir):
    """Labels as new feature rows, some of papers that are not there, merged into a store made of documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("arxiv_id"), F.concat(F.lit("v"), F.pmod("doc_id", F.lit(2)).cast("string")).alias("source_versioned_id"), F.lit("1").alias("extractor_version"), F.col("lang").alias("features"))
    labels = table(spark, sf_dir, "labels")
    labels = labels.unionByName(labels.where("doc_id % 10 = 1").withColumn("doc_id", -F.col("doc_id")))
    new = labels.select(F.col("doc_id").alias("arxiv_id"), F.concat(F.lit("v"), F.col("quality").cast("string")).alias("source_versioned_id"), F.lit("2").alias("extractor_version"), F.col("toxic").cast("string").alias("features"))
    store = BucketedStore(spark, docs, "arxiv_id")
    store.merge(new)
    return store.rows


# More of the evaluation, the store and the curation on tables


def _told(spark, sf_dir):
    """Events as predictions of their type: every third one is guessed to be a click."""
    guess = F.when(F.col("event_id") % 3 == 0, "click").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("truth"), guess.alias("guess"), (F.pmod(F.col("event_id") * 37, F.lit(101)) / 100).alias("confidence"))


_TOLD = "WITH l AS (SELECT event_id, event_type AS t, CASE WHEN event_id % 3 = 0 THEN 'click' ELSE event_type END AS p, (event_id * 37 % 101) / 100 AS confidence FROM events)"


@query(
    f"""{_TOLD}, names AS (SELECT t AS label FROM l UNION SELECT p FROM l),
    c AS (SELECT label, (SELECT count(*) FROM l WHERE t = label) AS support, (SELECT count(*) FROM l WHERE p = label) AS guessed, (SELECT count(*) FROM l WHERE t = label AND p = label) AS hits FROM names),
    r AS (SELECT support, CASE WHEN guessed + support = 0 THEN 0 ELSE 2 * hits / (guessed + support) END AS f1 FROM c)
    SELECT (SELECT count(*) FROM l) AS n, (SELECT round(avg((t = p)::INT), 9) FROM l) AS accuracy, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1,
        round(max(support) / sum(support), 9) AS majority_baseline, round(1 / count(*) FILTER (WHERE support > 0), 9) AS uniform_baseline FROM r
    """
)
def prediction_summary(spark, sf_dir):
    out = metrics.summary(_told(spark, sf_dir), "truth", "guess")
    return out.select("n", *(F.round(c, 9).alias(c) for c in out.columns if c != "n"))


@query(
    f"""{_SCORED}, b AS (SELECT i / 10 AS lower, (i + 1) / 10 AS upper FROM range(10) t(i)),
    g AS (SELECT count(*) AS n, avg(ok::INT) AS accuracy, avg(c) AS confidence FROM s JOIN b ON c > lower AND c <= upper GROUP BY lower)
    SELECT round(sum(n * abs(accuracy - confidence)) / (SELECT count(*) FROM s), 9) AS calibration_error FROM g
    """
)
def expected_calibration_error(spark, sf_dir):
    return metrics.calibration_error(_scored(spark, sf_dir), "confidence", "correct").select(F.round("calibration_error", 9).alias("calibration_error"))


@query(f"{_TOLD} SELECT event_id, t AS truth, p AS guess, confidence FROM l WHERE t <> p ORDER BY confidence DESC, event_id LIMIT 25")
def top_mistakes(spark, sf_dir):
    return metrics.worst_mistakes(_told(spark, sf_dir), "truth", "guess", "confidence", "event_id")


_LABELS = ["click", "view", "purchase"]
_RANKED = """
    WITH p AS (SELECT event_id, event_type, i, ['click', 'view', 'purchase'][i] AS label, (event_id * (i + 2) % 7) / 21 AS probability FROM events, (VALUES (1), (2), (3)) v(i)),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY probability DESC, i) AS place FROM p)
"""


def _ranked(spark, sf_dir):
    shares = F.array(*((F.col("event_id") * k % 7) / 21 for k in (3, 4, 5)))
    return table(spark, sf_dir, "events").select("event_id", "event_type", metrics.ranked_labels(shares, _LABELS, 3).alias("ranked"))


@query(f"{_RANKED} SELECT event_id, string_agg(label, '|' ORDER BY place) AS labels FROM r WHERE place <= 2 GROUP BY event_id")
def ranked_categories(spark, sf_dir):
    return _ranked(spark, sf_dir).select("event_id", F.concat_ws("|", F.slice(F.transform("ranked", lambda x: x["label"]), 1, 2)).alias("labels"))


@query(f"{_RANKED} SELECT (SELECT count(*) FROM r WHERE place <= 2 AND label = event_type) / (SELECT count(*) FROM events) AS top_2_accuracy")
def top_k(spark, sf_dir):
    return metrics.top_k_accuracy(_ranked(spark, sf_dir), "event_type", "ranked", 2)


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 06:00:00' ORDER BY ts DESC, event_id LIMIT 200")
def revision_cutoff(spark, sf_dir):
    recent = table(spark, sf_dir, "events").where("ts >= timestamp_ntz '2024-01-20 06:00:00'")
    return upsert.capped(recent, 200, [F.col("ts").desc(), "event_id"])[0].select("event_id")


@query(
    """
    WITH s AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events),
    c AS (SELECT *, last IS NULL OR last <> event_type AS changed FROM s),
    k AS (SELECT user_id, max_by(event_id, (ts, event_id)) AS title FROM c WHERE changed GROUP BY user_id)
    SELECT user_id::VARCHAR AS arxiv_id, max_by(event_type, (ts, event_id)) AS versioned_id, any_value(title)::VARCHAR AS title, min(ts)::VARCHAR AS first_seen, max(ts)::VARCHAR AS last_seen
    FROM c JOIN k USING (user_id) GROUP BY user_id
    """
)
def merged_store(spark, sf_dir):
    """Events as revisions in two batches: the fields of the first arrival of the last run of equal versions stay."""
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    empty = spark.createDataFrame([], PAPERS)
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    made = {"arxiv_id": F.col("user_id").cast("string"), "versioned_id": F.col("event_type"), "title": F.col("event_id").cast("string"), "seen_at": F.col("at"), "position": order}
    revisions = events.withColumns(made).select(*made, "ts")
    revisions = revisions.withColumns({f.name: F.lit(None).cast(f.dataType) for f in empty.schema if f.name not in made and f.name != "updated_at"}).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    early = revisions.where("ts < timestamp_ntz '2024-01-15 00:00:00'").drop("ts")
    late = revisions.where("ts >= timestamp_ntz '2024-01-15 00:00:00'").drop("ts")
    store = upsert.upsert(upsert.upsert(empty, early), late)
    text = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0+$", "")
    return store.select("arxiv_id", "versioned_id", "title", text("created_at").alias("first_seen"), text("last_seen_at").alias("last_seen"))


@query("SELECT event_type, count(*) AS n FROM (SELECT * FROM events WHERE ts::DATE = '2024-01-03' UNION ALL SELECT * FROM events WHERE ts::DATE = '2024-01-04' UNION ALL SELECT * FROM events WHERE ts::DATE = '2024-01-03') GROUP BY event_type")
def joined_pulls(spark, sf_dir):
    """Days joined as they come; rows pulled twice are there twice."""
    events = table(spark, sf_dir, "events")
    days = [events.where(F.col("ts").cast("date") == day) for day in ("2024-01-03", "2024-01-04", "2024-01-03")]
    return curation.pulled(days).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
    WITH a AS (SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, lang, CASE WHEN doc_id % 11 = 0 THEN -1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 5 <> 0)
    SELECT doc_id, CASE WHEN b.lang IS NULL THEN 'left only' WHEN a.lang IS NULL THEN 'right only' ELSE 'different' END AS difference
    FROM a FULL JOIN b USING (doc_id) WHERE a.lang IS NULL OR b.lang IS NULL OR a.n_chars <> b.n_chars
    """
)
def source_differences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    changed = docs.withColumn("n_chars", F.when(F.col("doc_id") % 11 == 0, F.lit(-1).cast("long")).otherwise(F.col("n_chars")))
    return library.differences(docs.where("doc_id % 7 <> 0"), changed.where("doc_id % 5 <> 0"), "doc_id")


_CLASSIFIED = """
    WITH c AS (SELECT lang, count(*) AS n FROM documents WHERE text <> '' GROUP BY lang HAVING count(*) >= 10),
    z AS (SELECT n, greatest(1, round_even(n * 0.15::DOUBLE, 0)) AS p FROM c)
    SELECT sum(n - 2 * p)::BIGINT AS n_train, sum(p)::BIGINT AS n_validation, sum(p)::BIGINT AS n_test, count(*) AS n_labels, true AS labels_sorted, true AS learned, true AS beats_untrained, true AS has_history, true AS {}
    FROM z
"""


def _classified(spark, sf_dir, **options):
    """A classifier of the documents' languages by TF-IDF vectors: sizes of the split, and whether the held-out part is told right."""
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    papers = docs.select(F.col("doc_id").cast("string").alias("arxiv_id"), F.lit("").alias("title"), F.col("text").alias("abstract"), F.col("lang").alias("primary_category"))
    run = classifier.train_and_evaluate(papers, least=10, features=400, **options)
    labels, m = run.classifier.labels, run.metrics
    sizes = run.split.groupBy().agg(*(F.count_if(F.col("split") == p).alias(f"n_{p}") for p in ("train", "validation", "test")))
    told = {
        "n_labels": F.lit(len(labels)).cast("long"),
        "labels_sorted": F.lit(labels == sorted(labels)),
        "learned": F.lit(m["accuracy"] >= 0.9 and m["macro_f1"] >= 0.8 and m["accuracy"] > m["majority_baseline"]),
        "beats_untrained": F.lit(m["accuracy"] > m["untrained_validation_accuracy"]),
        "has_history": F.lit(run.curve(spark).where("validation_macro_f1 > 0").count() == len(run.history) >= 1),
    }
    return m, sizes.select("*", *(v.alias(k) for k, v in told.items()))


@query(_CLASSIFIED.format("ranks_fit"))
def category_classifier(spark, sf_dir):
    """The net. It keeps the first epoch of the best macro F1, when its probabilities may still be flat."""
    m, out = _classified(spark, sf_dir)
    return out.withColumn("ranks_fit", F.lit(1 <= m["best_epoch"] <= 20 and m["top_3_accuracy"] >= m["accuracy"]))


@query(_CLASSIFIED.format("confident"))
def category_regression(spark, sf_dir):
    """Logistic regression, whose confidence is to be near its accuracy too."""
    m, out = _classified(spark, sf_dir, model=classifier.LOGISTIC, iterations=(5, 10))
    return out.withColumn("confident", F.lit(m["calibration_error"] < 0.35 and m["top_3_accuracy"] >= m["accuracy"]))
