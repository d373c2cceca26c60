"""Records over whole tables: ids, names, feed entries, JSON lines, files, an ingest, prompts.

The driver's tables hold no feeds and no lines; each query makes them of a table's own columns, a record for each row.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vellumflow.functions import text as T
from vellumflow.functions.unicode import canonical_key, normal_name
from vellumflow.operators.metrics import evidence_coverage
from vellumflow.operators.selection import prompt_text
from vellumflow.plans.extraction import FEATURES_SQL, featured
from vellumflow.plans.registry import query, table
from vellumflow.schemas import PAPERS
from vellumflow.sources import feed, jsonl
from vellumflow.sources.shared import run_folder
from vellumflow.streaming.ingest import Store, fetch


def _text(c):
    return F.col(c).cast("string") if isinstance(c, str) else c


def _joined(*parts):
    """Strings as they are, and columns in (name,)."""
    return F.concat(*(_text(p[0]) if isinstance(p, tuple) else F.lit(p) if isinstance(p, str) else p for p in parts))


@query(
    f"""{FEATURES_SQL}
    SELECT documents.doc_id, CASE WHEN count(label) = 0 THEN 1.0::DOUBLE ELSE count(label) FILTER (WHERE statement <> '') / count(label) END AS coverage
    FROM documents LEFT JOIN shown USING (doc_id) GROUP BY documents.doc_id
    """
)
def document_coverage(spark, sf_dir):
    """The share of each document's values that evidence supports."""
    return featured(spark, sf_dir).select("doc_id", evidence_coverage(F.col("features")).alias("coverage"))


# Ids and names

def _number():
    return F.lpad(F.col("doc_id").cast("string"), 7, "0")


@query(
    """
    WITH d AS (SELECT doc_id, lang || '-x/' || lpad(doc_id::VARCHAR, 7, '0') AS base, lpad(doc_id::VARCHAR, 7, '0') AS number, ['', 'v2', 'V13'][doc_id % 3 + 1] AS suffix FROM documents)
    SELECT doc_id, base, [1, 2, 13][doc_id % 3 + 1] AS version, number || suffix AS versioned, CASE WHEN suffix = 'v2' THEN number ELSE number || suffix END AS feed_base,
        'http:__arxiv.org_abs_' || replace(base, '/', '_') || suffix || '.pdf' AS file FROM d
    """
)
def document_ids(spark, sf_dir):
    """An id with and without a version for every document, taken apart."""
    suffix = F.get(F.array(*map(F.lit, ("", "v2", "V13"))), F.pmod("doc_id", F.lit(3)).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", _joined("http://arxiv.org/abs/", ("lang",), "-x/", _number(), suffix).alias("s"))
    split, named = T.split_version("s"), T.feed_id("s")
    return docs.select("doc_id", split["base"].alias("base"), split["version"].alias("version"), named["versioned"].alias("versioned"), named["base"].alias("feed_base"), T.file_name("s").alias("file"))


@query(
    r"""
    WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS x FROM documents),
    n AS (SELECT doc_id, trim(regexp_replace(nfc_normalize(x), '\s+', ' ', 'g')) AS name, trim(regexp_replace(strip_accents(replace(lower(x), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g')) AS key FROM d)
    SELECT doc_id, sha256(name) AS name_sha256, key, 'paper:' || sha256(key)[1:16] AS node_id FROM n
    """
)
def document_nodes(spark, sf_dir):
    """Every document's first line as a name, its canonical key, and the node of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("x"))
    named = docs.select("doc_id", normal_name("x").alias("name"), canonical_key("x").alias("key"))
    return named.select("doc_id", F.sha2("name", 256).alias("name_sha256"), "key", T.node_id(F.lit("Paper"), F.col("key")).alias("node_id"))


# Feeds and lines


@query(
    """
    WITH d AS (SELECT *, lang || '/' || lpad(doc_id::VARCHAR, 7, '0') AS base, lpad(doc_id::VARCHAR, 7, '0') AS number, doc_id % 3 + 1 AS v, doc_id % 9 + 1 AS day FROM documents)
    SELECT base AS store_id, base || 'v' || v AS store_versioned, v::INTEGER AS version, number AS arxiv_id, number || 'v' || v AS versioned_id, 'Paper ' || doc_id AS title, 'About ' || source || '.' AS abstract, 'Ann ' || source || '|Bo' AS authors,
        lang || '.X|x.' || source AS categories, lang || '.X' AS primary_category, '2026-07-0' || day AS submitted_date, 'http://arxiv.org/abs/' || base AS abs_url, 'http://arxiv.org/pdf/' || base AS pdf_url,
        CASE WHEN doc_id % 2 = 0 THEN '10.1/' || doc_id END AS doi, '{"Ann ' || source || '":["' || lang || ' Lab"]}' AS affiliations, '2026-07-0' || day || ' 01:00:00' AS updated
    FROM d
    """
)
def feed_papers(spark, sf_dir):
    """A feed entry for every document, read into dataset rows and store rows."""
    base = _joined(("lang",), "/", _number())
    v, day = (F.pmod("doc_id", F.lit(n)).cast("int") + 1 for n in (3, 9))
    entry = _joined(
        "<entry xmlns:arxiv='http://arxiv.org/schemas/atom'><id>http://arxiv.org/abs/", base, "v", (v,), "</id><title> Paper\n  ", ("doc_id",), "</title><summary> About  ", ("source",), ". </summary><published>2026-07-0", (day,),
        "T00:10:00Z</published><updated>2026-07-0", (day,), "T01:00:00Z</updated><author><name>Ann  ", ("source",), "</name><arxiv:affiliation>", ("lang",), " Lab</arxiv:affiliation></author><author><name>Bo</name></author>",
        "<link href='http://arxiv.org/abs/", base, "' rel='alternate' type='text/html'/><link title='pdf' href='http://arxiv.org/pdf/", base, "' rel='related' type='application/pdf'/><category term='", ("lang",), ".X'/><category term='x.", ("source",),
        "'/><arxiv:primary_category term='", ("lang",), ".X'/><arxiv:doi>", F.when(F.pmod("doc_id", F.lit(2)) == 0, _joined("10.1/", ("doc_id",))).otherwise(" "), "</arxiv:doi></entry>",
    )
    entries = table(spark, sf_dir, "documents").select(F.from_xml(entry, feed.ENTRY, {"ignoreNamespace": "true"}).alias("e")).select("e.*")
    papers = feed.papers_of(entries).select("title", "arxiv_id", "versioned_id", "abstract", F.concat_ws("|", "authors").alias("authors"), F.concat_ws("|", "categories").alias("categories"), "primary_category", "submitted_date", "abs_url", "pdf_url", "doi")
    stored = feed.records_of(entries).select("title", F.col("arxiv_id").alias("store_id"), F.col("versioned_id").alias("store_versioned"), "version", F.to_json("affiliations").alias("affiliations"), F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))
    return papers.join(stored, "title")


@query(
    """
    WITH f AS (SELECT *, (doc_id % 10)::INTEGER AS k, min(doc_id) FILTER (WHERE doc_id % 10 = 3) OVER () AS first FROM documents)
    SELECT doc_id AS line, CASE WHEN k IN (0, 4, 5) THEN 'not a JSON object' WHEN k = 1 THEN 'title is missing' WHEN k = 2 THEN 'submitted_date is no date' WHEN k = 3 AND doc_id > first THEN 'arxiv_id is repeated' END AS strict,
        CASE WHEN k IN (0, 5) THEN 'not a JSON object' WHEN k = 1 THEN 'title is missing' WHEN k = 3 AND doc_id > first THEN 'arxiv_id is repeated, first on line ' || first END AS lenient
    FROM f
    """
)
def line_problems(spark, sf_dir):
    """A JSON line for every document, six of ten with a fault, as both readers see it."""
    k = F.pmod("doc_id", F.lit(10))
    fields = F.struct(
        F.when(k == 3, "same").otherwise(F.col("doc_id").cast("string")).alias("arxiv_id"),
        F.lit("v1").alias("versioned_id"),
        F.when(k == 2, "2026-7-3").otherwise("2026-07-03").alias("submitted_date"),
        F.when(k == 1, " ").otherwise(F.col("source")).alias("title"),
        F.col("text").alias("abstract"),
        F.col("lang").alias("primary_category"),
    )
    value = F.when(k == 0, "{").when(k == 4, " ").when(k == 5, "[1]").otherwise(F.to_json(fields))
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), value.alias("value"))
    strict = jsonl.paper_problems(lines).select("line", F.col("problem").alias("strict"))
    return strict.join(jsonl.example_problems(lines).select("line", F.col("problem").alias("lenient")), "line", "left")


@query("""SELECT '{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"note":null,"source":"' || source || '"}' AS line FROM documents""")
def written_lines(spark, sf_dir):
    """Documents written as JSON lines with sorted keys and nulls, and read again as text."""
    path = run_folder(spark, "lines")
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", "lang", F.lit(None).cast("string").alias("note"))
    jsonl.write_lines(docs, path, ["doc_id"])
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT 'date,paper_count' AS line UNION ALL SELECT ts::DATE || ',' || count(*) FROM events GROUP BY ts::DATE")
def written_counts(spark, sf_dir):
    """Events counted by day, written with a header and read again as text."""
    path = run_folder(spark, "counts")
    jsonl.write_counts(table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("paper_count")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# Ingest

NOW = datetime(2024, 6, 20, 12)


@query(
    """
    SELECT doc_id::VARCHAR AS arxiv_id, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN doc_id % 4000 <= 1440 THEN 'first' ELSE 'second' END AS seen
    FROM documents WHERE lang IN ('en', 'de') AND (doc_id % 4000 <= 1440 OR doc_id % 7 = 0)
    """
)
def ingested(spark, sf_dir):
    """Two runs over documents as submissions: the first looks back a day, the second finds new versions of old ones too."""
    docs = table(spark, sf_dir, "documents")
    there = [f.name for f in spark.createDataFrame([], PAPERS).schema]

    def landing(version, updated):
        published = F.lit(NOW) - F.make_dt_interval(mins=F.pmod("doc_id", F.lit(4000)).cast("int"))
        made = {"arxiv_id": F.col("doc_id").cast("string"), "versioned_id": _joined(("doc_id",), "v", (version,)), "version": version, "title": F.col("source"), "categories": F.array("lang"), "published_at": published}
        made["updated_at"] = F.coalesce(updated, published)
        kinds = {f.name: f.dataType for f in spark.createDataFrame([], PAPERS).schema}
        return docs.select(*(made[c].alias(c) if c in made else F.lit(None).cast(kinds[c]).alias(c) for c in there))

    store = Store(spark, run_folder(spark, "store"), buckets=8)
    again = F.pmod("doc_id", F.lit(7)) == 0
    # No run is to be saturated here.
    cap = docs.count() + 1
    fetch(store, landing(F.lit(1), F.lit(None).cast("timestamp")), ["en", "de"], NOW, cap=cap)
    later = NOW + timedelta(hours=2)
    fetch(store, landing(F.when(again, 2).otherwise(1), F.when(again, F.lit(NOW + timedelta(hours=1)))), ["en", "de"], later, cap=cap)
    state = store.state.agg(F.min("state_value").alias("low"), F.count(F.lit(1)).alias("n")).head()
    if (state.low, state.n) != (later, 2):
        raise ValueError("both checkpoints stand at the second run's time")
    return store.papers.select("arxiv_id", "version", F.when(F.col("created_at") == F.lit(NOW), "first").otherwise("second").alias("seen"))


# Page texts and prompts


@query(
    r"""
    WITH j AS (SELECT doc_id, chr(10) || '=== PAGE 1 ===' || chr(10) || text || chr(10) || '=== PAGE 2 ===' || chr(10) || source AS t FROM documents)
    SELECT doc_id, CASE WHEN length(regexp_replace(t, '\s+', '', 'g')) >= 200 THEN sha256(t) END AS text_sha256 FROM j
    """
)
def page_texts(spark, sf_dir):
    """Every document as two pages; null where too little came out."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.readable_pages(F.array("text", "source")), 256).alias("text_sha256"))


_PAPER = """
    h AS (SELECT *, 'TITLE' || chr(10) || 'T' || doc_id || chr(10) || chr(10) || 'ABSTRACT' || chr(10) || lang || chr(10) AS header FROM documents),
    n AS (SELECT *, {} - length(header) AS room FROM h)
"""


@query(
    f"""
    WITH {_PAPER.format(400)}, b AS (
        SELECT *, 'METHODS' || chr(10) || source AS one, '2 Results' || chr(10) || 'n=' || n_chars AS two, 'CONCLUSION' || chr(10) || lang AS three FROM n
    ), w AS (SELECT *, 'INTRODUCTION' || chr(10) || text || chr(10) || one || chr(10) || two || chr(10) || three AS body FROM b)
    SELECT doc_id, header || CASE WHEN length(body) + 17 <= room THEN chr(10) || 'FULL PAPER TEXT' || chr(10) || body
        ELSE chr(10) || 'PRIORITIZED PAPER SECTIONS' || chr(10) || one || chr(10) || chr(10) || two || chr(10) || chr(10) || three END AS prompt FROM w
    """
)
def section_prompts(spark, sf_dir):
    """Prompts of documents under headings: all that fits, else the sections that count."""
    body = _joined("INTRODUCTION\n", ("text",), "\nMETHODS\n", ("source",), "\n2 Results\nn=", ("n_chars",), "\nCONCLUSION\n", ("lang",))
    papers = table(spark, sf_dir, "documents").select("doc_id", _joined("T", ("doc_id",)).alias("title"), F.col("lang").alias("abstract"), body.alias("full_text"))
    return prompt_text(papers, 400).select("doc_id", "prompt")


_MARK = "replace(" + "'" + T.OMISSION.replace("\n", "~") + "', '~', chr(10))"


@query(
    f"""
    WITH {_PAPER.format(900)}, c AS (SELECT *, room - 26 - {len(T.OMISSION)} AS content FROM n), f AS (SELECT *, floor(content * 0.75)::BIGINT AS first FROM c)
    SELECT doc_id, header || CASE WHEN text = '' THEN '' WHEN length(text) + 17 <= room THEN chr(10) || 'FULL PAPER TEXT' || chr(10) || text
        ELSE chr(10) || 'SELECTED FULL PAPER TEXT' || chr(10) || text[:first] || {_MARK} || right(text, content - first) END AS prompt FROM f
    """
)
def part_prompts(spark, sf_dir):
    """Prompts of documents without headings: all that fits, else front and back."""
    papers = table(spark, sf_dir, "documents").select("doc_id", _joined("T", ("doc_id",)).alias("title"), F.col("lang").alias("abstract"), F.col("text").alias("full_text"))
    return prompt_text(papers, 900).select("doc_id", "prompt")
