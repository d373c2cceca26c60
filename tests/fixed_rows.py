"""Small cases on fixed rows, with their results as fixed rows too; test_queries.py runs them. Queries on the given tables are in
vellumflow/plans.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from given import query, values

from vellumflow.functions import text as T
from vellumflow.functions import validation
from vellumflow.functions.unicode import canonical_key, casefolded, normal_name
from vellumflow.operators import curation, library, metrics, terms, upsert
from vellumflow.operators.claims import envelopes
from vellumflow.operators.features import DATASETS, DOMAINS, METHODS, METRICS, TASKS, extractor, matched, titled_or_used
from vellumflow.operators.selection import prompt_text
from vellumflow.schemas import FEATURES, PAPERS
from vellumflow.sources import feed, jsonl


def rows(spark: SparkSession, schema: str, data: list) -> DataFrame:
    return spark.createDataFrame(data, schema)


def listed(c: Column) -> Column:
    return F.concat_ws("|", c)


# Terms and features

TERMS = [
    (1, "Fashion-MNIST results on MNIST"),
    (2, "Transformers are no transformer"),
    (3, "CIFAR-100 and cifar10"),
    (4, "éaccuracy"),
    (5, "a language model for text and images"),
    (6, None),
    (7, "Outlier detection in clinical temporal data by a GNN"),
    (8, "A VAE and a GAN read text; BLEU and perplexity on WikiText."),
    (9, "Policy optimization, then regression with random forests: MSE and roc-auc on FashionMNIST"),
]


@query(
    values(
        "id methods datasets metrics tasks domains",
        [
            (1, "", "MNIST|Fashion-MNIST", "", "", ""),
            (2, "transformer", "", "", "", ""),
            (3, "", "CIFAR-10|CIFAR-100", "", "", ""),
            (4, "", "", "", "", ""),
            (5, "", "", "", "", "natural language processing"),
            (6, "", "", "", "", ""),
            (7, "graph neural network", "", "", "anomaly detection", "healthcare|time series"),
            (8, "variational autoencoder|generative adversarial network", "WikiText", "BLEU|perplexity", "", "natural language processing"),
            (9, "reinforcement learning|random forest", "Fashion-MNIST", "AUROC|mean squared error", "regression", ""),
        ],
    )
)
def vocabulary_terms(spark, sf_dir):
    lists = {"methods": METHODS, "datasets": DATASETS, "metrics": METRICS, "tasks": TASKS, "domains": DOMAINS}
    return rows(spark, "id int, text string", TERMS).select("id", *(listed(matched(F.col("text"), v)).alias(n) for n, v in lists.items()))


MADE_UP = "A fictional paper"
USED = [
    (1, MADE_UP, "Related work reads GLUE benchmark scores with a GNN. Here a VAE learns WikiText."),
    (2, MADE_UP, "Earlier work relies on a GNN, however a CNN is enough for MNIST."),
    (3, MADE_UP, "Other studies need ImageNet; a GAN needs LibriSpeech."),
    (4, MADE_UP, "Previous work tunes an LLM\nwhile a VAE reads MMLU."),
    (5, "A GAN against Transformers", "Prior work scores with RAG. Nothing else."),
    (6, MADE_UP, "Nothing of the kind is named here."),
    (7, MADE_UP, ""),
]


@query(
    values(
        "id methods datasets",
        [
            (1, "variational autoencoder", "WikiText"),
            (2, "convolutional neural network", "MNIST"),
            (3, "generative adversarial network", "LibriSpeech"),
            (4, "variational autoencoder", "MMLU"),
            (5, "generative adversarial network", ""),
            (6, "", ""),
            (7, "", ""),
        ],
    )
)
def used_terms(spark, sf_dir):
    df = rows(spark, "id int, title string, body string", USED)
    return df.select("id", *(listed(titled_or_used(F.col("title"), F.col("body"), v)).alias(n) for n, v in {"methods": METHODS, "datasets": DATASETS}.items()))


USE = "A CNN sorts clinical scans by segmentation of HumanEval."
GAIN = "Here our contribution is a shorter schedule."
COST = "Limitations are the long runs."
TRUSTED = "https://github.com/ann/tool https://raw.github.com/ann/tool https://gitlab.com/bo/kit https://pages.gitlab.com/bo https://huggingface.co/cy/net https://cdn.huggingface.co/cy"
ALIKE = "https://github.com.mirror.test/a https://my-github.com/b https://gitlab.com.copy.test/c https://huggingface.co.fake.test/d"
UNLIMITED = "The method is never limited to text."
FEATURED = [
    (1, MADE_UP, f"{USE} {GAIN} {COST}", f"{USE} {GAIN} {COST}"),
    (2, "", "", ""),
    (3, "of the", "and if", "of the and if"),
    (4, MADE_UP, UNLIMITED, None),
    (5, MADE_UP, f"Code: {TRUSTED}", ""),
    (6, MADE_UP, f"Code: {ALIKE}", ""),
    (7, "A VAE", "Our evaluation indicates better recall. It is new.", None),
]


@query(
    values(
        "id summary tasks methods datasets metrics domains contributions limitations code_urls no_keywords evidence claims confidence",
        [
            (1, USE, "segmentation", "convolutional neural network", "HumanEval", "", "healthcare", GAIN, COST, "", False,
             f"research_tasks:segmentation:{USE}|methods:convolutional neural network:{USE}|datasets:HumanEval:{USE}|domains:healthcare:{USE}|contributions:{GAIN}:{GAIN}|limitations:{COST}:{COST}", 0, 0.35),
            (2, "No abstract available.", "", "", "", "", "", "", "", "", True, "", 0, 0.35),
            (3, "and if", "", "", "", "", "", "", "", "", True, "", 0, 0.35),
            (4, UNLIMITED, "", "", "", "", "natural language processing", "", "", "", False, f"domains:natural language processing:{UNLIMITED}", 0, 0.35),
            (5, f"Code: {TRUSTED}", "", "", "", "", "", "", "", TRUSTED.replace(" ", "|"), False, "", 0, 0.35),
            (6, f"Code: {ALIKE}", "", "", "", "", "", "", "", "", False, "", 0, 0.35),
            (7, "Our evaluation indicates better recall.", "", "variational autoencoder", "", "recall", "", "", "", "", False, "methods:variational autoencoder:A VAE|metrics:recall:Our evaluation indicates better recall.", 1, 0.35),
        ],
    )
)
def extracted_features(spark, sf_dir):
    df = extractor("rules")(rows(spark, "id int, title string, abstract string, paper_text string", FEATURED))
    f = F.col("features")
    said = F.transform(f["evidence"], lambda e: F.concat_ws(":", e["field"], e["value"], e["statement"]))
    return df.select(
        "id",
        f["one_sentence_summary"].alias("summary"),
        listed(f["research_tasks"]).alias("tasks"),
        *(listed(f[c]).alias(c) for c in ("methods", "datasets", "metrics", "domains", "contributions", "limitations", "code_urls")),
        (F.size(f["keywords"]) == 0).alias("no_keywords"),
        listed(said).alias("evidence"),
        F.size(f["validity_envelopes"]).alias("claims"),
        f["confidence"].alias("confidence"),
    )


@query(values("id coverage", [(1, 1.0), (2, 0.5), (3, 1.0), (4, 0.0)]))
def coverage_of_evidence(spark, sf_dir):
    fields = ", ".join(f"{f}:array<string>" for f in metrics.VALUE_FIELDS)
    record = lambda methods, said: {f: [] for f in metrics.VALUE_FIELDS} | {"methods": methods, "evidence": said}
    data = [
        (1, record(["A"], [{"field": "methods", "value": "a", "statement": "s"}])),
        (2, record(["a", "b"], [{"field": "methods", "value": "B", "statement": "s"}])),
        (3, record([], [])),
        (4, record(["a"], [{"field": "metrics", "value": "a", "statement": "s"}])),
    ]
    df = rows(spark, f"id int, features struct<{fields},evidence:array<struct<field:string,value:string,statement:string>>>", data)
    return df.select("id", metrics.evidence_coverage(F.col("features")).alias("coverage"))


# Claims: abstract, and the fields of its first envelope that are asked for

SHIFT = "Relative to plain forests, we report 3.5 percentage points better recall on MNIST under heavy noise (p < 0.05)."
BOUND = "Future work is needed on one server."
PAIRED = "We confirm that our tree outperforms not only method K but {} method L."
CLAIMS: list[tuple[str, dict]] = [
    (
        f"{SHIFT} {BOUND}",
        {"n": 1, "claim": SHIFT, "claim_type": "comparative", "direction": "positive", "comparators": "plain forests", "evaluation_contexts": "MNIST", "metrics": "recall", "reported_values": "3.5 percentage points",
         "effect_sizes": "3.5 percentage points", "uncertainty": "p < 0.05", "conditions": "under heavy noise", "paper_level_boundaries": BOUND, "source": "abstract", "sentence_index": 0, "statement": SHIFT, "confidence": "0.85"},
    ),
    ("We describe a survey of open questions.", {"n": 0}),
    (None, {"n": 0}),
    ("Some background first.We observe less noise.", {"n": 1, "claim": "We observe less noise.", "sentence_index": 1}),
    ("Related work shows gains on MNIST. We explain our setup.", {"n": 0}),
    ("Our evaluation shows cleaner maps compared to dense sampling and can outperform full manual (FM) labelling under some conditions.", {"comparators": "dense sampling|full manual (FM) labelling"}),
    (PAIRED.format("also"), {"claim": PAIRED.format("also"), "comparators": "method K|method L"}),
    (PAIRED.format("even"), {"claim": PAIRED.format("even"), "comparators": "method K|method L"}),
    ("We achieve lower error compared to AlexNet on LibriSpeech.", {"comparators": "AlexNet", "evaluation_contexts": "LibriSpeech"}),
    ("We achieve lower error compared to Mamba while needing a third of the memory.", {"comparators": "Mamba"}),
    ("We observe that our probe outperforms raw baselines while staying cheap.", {"comparators": "raw baselines"}),
    ("Results suggest a hit rate of 64.5%, ahead of others by 8.2% to 19.4%.", {"reported_values": "64.5%|8.2%|19.4%", "effect_sizes": "by 8.2% to 19.4%"}),
    ("Our analysis reveals a 12-fold speedup over loops.", {"reported_values": "12-fold", "effect_sizes": "12-fold speedup"}),
    (r"Our experiments indicate a {7\%} rise.", {"reported_values": r"{7\%}"}),
    ("Our results suggest that it is 2-6x quicker.", {"reported_values": "2-6x"}),
    ("Our results suggest that it is 3.5x quicker.", {"reported_values": "3.5x"}),
    ("We find a change by a factor of 9.", {"reported_values": "factor of 9"}),
    ("We find a loss of 41 dB.", {"reported_values": "41 dB"}),
    ("We find a gap of 0.75mm.", {"reported_values": "0.75mm"}),
    ("We find AUROC 0.88.", {"reported_values": "0.88"}),
    (r"We report a 90% confidence interval of 2.3 to 2.9, p = 3e-4, and 0.512 \pm 0.021.", {"uncertainty": r"p = 3e-4|90% confidence interval of 2.3 to 2.9|0.512 \pm 0.021"}),
    (r"We report a shift of -0.3% $\pm$ 0.1%.", {"uncertainty": r"-0.3% $\pm$ 0.1%"}),
    ("Across rural, urban, and mixed sites, our analysis suggests fewer errors.", {"conditions": "Across rural, urban, and mixed sites"}),
    ("When power is scarce, while the fan is off, our analysis suggests fewer errors.", {"conditions": "When power is scarce"}),
    ("Across nine sites and the results reveal that errors drop.", {"conditions": "Across nine sites"}),
    ("We observe gains when loads are small, and it also holds up when run on old machines.", {"conditions": "when loads are small|when run on old machines"}),
    ("To overcome these limitations, a new loop is built. We observe fewer errors.", {"paper_level_boundaries": ""}),
    ("We show that sleep leads to fewer errors versus coffee.", {"claim_type": "causal_language"}),
    ("Many experiments confirm that our framework attains 77% recall.", {"n": 1, "reported_values": "77%"}),
    ("We report no improvement in recall on MMLU.", {"n": 1, "direction": "negative", "metrics": "recall", "evaluation_contexts": "MMLU", "effect_sizes": ""}),
    ("We observe that rain is linked to delay.", {"claim_type": "associational", "direction": "unclear"}),
    ("We observe that the index forecasts delay.", {"claim_type": "predictive"}),
    ("We establish a plain rule.", {"claim_type": "descriptive", "confidence": "0.55"}),
    ("We find that K does not grow and is better.", {"direction": "mixed"}),
    ("We report k. we report K. We show b. We find c. We confirm d. We achieve e. We observe f.", {"n": 5}),
    ("We observe it. The cause remains unknown. Future work will tell. It struggles to start. It cannot stop.", {"paper_level_boundaries": "The cause remains unknown.|Future work will tell.|It struggles to start."}),
]


@query(values("id field value", [(i, k, str(v)) for i, (_, wanted) in enumerate(CLAIMS) for k, v in wanted.items()]))
def claim_envelopes(spark, sf_dir):
    df = rows(spark, "id int, abstract string, wanted array<string>", [(i, text, list(wanted)) for i, (text, wanted) in enumerate(CLAIMS)])
    df = df.select("id", "wanted", envelopes(F.col("abstract")).alias("e")).withColumn("first", F.get("e", F.lit(0)))
    e = F.col("first")
    lists = ("comparators", "evaluation_contexts", "metrics", "reported_values", "effect_sizes", "uncertainty", "conditions", "paper_level_boundaries")
    told = {"n": F.size("e"), "claim": e["claim"], "claim_type": e["claim_type"], "direction": e["direction"], **{k: listed(e[k]) for k in lists}}
    told |= {"source": e["evidence"]["source"], "sentence_index": e["evidence"]["sentence_index"], "statement": e["evidence"]["statement"], "confidence": F.format_number(e["confidence"], 2)}
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in told.items())))
    return df.select("id", "wanted", pairs.alias("p")).where("array_contains(wanted, p.field)").select("id", "p.field", "p.value")


# Prompts

HEADER = "TITLE\nPaper\n\nABSTRACT\nAbstract.\n"
MIDDLE = "BEGIN " + "middle " * 200 + " END"
METHOD, TRIALS, END = "METHODS\nA small tree is grown.", "3.1 Experiments\nIt is run on MNIST.", "CONCLUSION\nIt is cheap."
LONG = "METHODS\n" + "m" * 500 + "\nRESULTS\n" + "r" * 500 + "\nLIMITATIONS\nSmall."


def _around(text: str, budget: int) -> str:
    content = budget - len(T.OMISSION)
    front = int(content * 0.75)
    return text[:front] + T.OMISSION + text[len(text) - (content - front) :]


PROMPTS = [
    (1, 200, "short", f"{HEADER}\nFULL PAPER TEXT\nshort"),
    (2, 200, None, HEADER),
    (3, len(HEADER) + 1, LONG, HEADER),
    (4, 350, "INTRODUCTION\n" + "background " * 200 + f"\n{METHOD}\n{TRIALS}\n{END}\n", f"{HEADER}\nPRIORITIZED PAPER SECTIONS\n{METHOD}\n\n{TRIALS}\n\n{END}"),
    (5, 250, MIDDLE, f"{HEADER}\nSELECTED FULL PAPER TEXT\n" + _around(MIDDLE, 250 - len(HEADER) - 26)),
    # 100 characters for three sections and two breaks: 32 for each.
    (6, len(HEADER) + 28 + 100, LONG, f"{HEADER}\nPRIORITIZED PAPER SECTIONS\nMETHODS\n{'m' * 24}\n\nRESULTS\n{'r' * 24}\n\nLIMITATIONS\nSmall."),
    # 4 characters do not hold more than the breaks: headings only.
    (7, len(HEADER) + 28 + 4, LONG, f"{HEADER}\nPRIORITIZED PAPER SECTIONS\nMETH"),
]


@query(values("id prompt", [(i, prompt) for i, _, _, prompt in PROMPTS]))
def prompt_selection(spark, sf_dir):
    out = None
    for i, most, text, _ in PROMPTS:
        df = prompt_text(rows(spark, "id int, title string, abstract string, full_text string", [(i, "Paper", "Abstract.", text)]), most).select("id", "prompt")
        out = df if out is None else out.unionByName(df)
    return out


# Ids, names and small text functions


@query(
    values(
        "id base version versioned feed_base file",
        [
            (1, "2107.05580", 3, "2107.05580v3", "2107.05580", "2107.05580v3.pdf"),
            (2, "quant-ph/0201082", 1, "0201082v1", "0201082", "quant-ph_0201082v1.pdf"),
            (3, "2107.05580", 1, "2107.05580", "2107.05580", "2107.05580.pdf"),
            (4, "2107.05580", 12, "2107.05580V12", "2107.05580V12", "http:__arxiv.org_abs_2107.05580V12.pdf"),
        ],
    )
)
def paper_ids(spark, sf_dir):
    df = rows(spark, "id int, s string", [(1, "2107.05580v3"), (2, "quant-ph/0201082v1"), (3, "2107.05580"), (4, "http://arxiv.org/abs/2107.05580V12")])
    split, named = T.split_version("s"), T.feed_id("s")
    return df.select("id", split["base"].alias("base"), split["version"].alias("version"), named["versioned"].alias("versioned"), named["base"].alias("feed_base"), T.file_name("s").alias("file"))


@query(
    values(
        "id name key folded",
        [(1, "Fréchet Straße", "frechet strasse", "ｆréchet  strasse"), (2, "ﬁne A&B".replace("ﬁ", "fi"), "fine a b", "fine a&b"), (3, None, None, None), (4, "", "", " \t"), (5, "Σίσυφος", "", "σίσυφοσ")],
    )
)
def paper_names(spark, sf_dir):
    df = rows(spark, "id int, s string", [(1, "Ｆréchet  Straße"), (2, "ﬁne A&B"), (3, None), (4, " \t"), (5, "Σίσυφος")])
    return df.select("id", normal_name("s").alias("name"), canonical_key("s").alias("key"), casefolded("s").alias("folded"))


@query(
    values(
        "id squeezed first short n_words clauses tight",
        [
            (1, "One. Two! Three? Four", "One.", "One. Two! Three? Four", 4, "One. Two! Three? Four", "One.|Two!|Three?|Four"),
            (2, "a; b, but c however d", "a; b, but c however d", "a; b, but c however d", 6, "a| b|c|d", "a; b, but c however d"),
            (3, "not only a; b but also c", "not only a; b but also c", "not only a; b but also c", 7, "not only a; b but also c", "not only a; b but also c"),
            (4, "No space.Yes it is", "No space.Yes it is", "No space.Yes it is", 4, "No space.Yes it is", "No space.|Yes it is"),
            (5, "", "", "", 0, "", ""),
            (6, "x" * 300, "x" * 300, "x" * 237 + "...", 1, "x" * 300, "x" * 300),
        ],
    )
)
def text_pieces(spark, sf_dir):
    data = [(1, " One.  Two! Three?\tFour "), (2, "a; b, but c however d"), (3, "not only a; b but also c"), (4, "No space.Yes it is"), (5, "   "), (6, "x" * 300)]
    df = rows(spark, "id int, s string", data).withColumn("c", T.squeeze("s"))
    c = F.col("c")
    return df.select("id", c.alias("squeezed"), T.first_sentence("s").alias("first"), T.short_statement("s").alias("short"), T.n_words("s").cast("int").alias("n_words"), listed(T.claim_clauses(c)).alias("clauses"), listed(T.tight_sentences(c)).alias("tight"))


@query(
    values(
        "id is_date is_category one_each folded",
        [(1, True, True, "b|a", "B|a"), (2, False, False, "a|A", "a"), (3, False, True, "", ""), (4, False, False, "ü|Ü|x", "ü|x")],
    )
)
def small_checks(spark, sf_dir):
    data = [(1, "2026-07-03", "cs.LG", ["b", "a", "b"], ["B", "b", "a"]), (2, "2026-7-3", "LG", ["a", "A"], ["a", "A"]), (3, "2026-02-30", "hep-th", [], []), (4, None, "cs.LG2", ["ü", "Ü", "x", "ü"], ["ü", "Ü", "x"])]
    df = rows(spark, "id int, day string, category string, a array<string>, b array<string>", data)
    return df.select("id", T.valid_date("day").alias("is_date"), T.valid_category("category").alias("is_category"), listed(F.array_distinct("a")).alias("one_each"), listed(T.distinct_folded(F.col("b"))).alias("folded"))


PAGE = "word " * 50


@query(
    values(
        "id may_store text",
        [(1, True, f"\n=== PAGE 1 ===\n{PAGE}\n=== PAGE 2 ===\n{PAGE}"), (2, False, None), (3, False, None), (4, True, None)],
    )
)
def pdf_rules(spark, sf_dir):
    data = [(1, "https://arxiv.org/pdf/1", "%PDF-1.7", [PAGE, PAGE]), (2, "https://arxiv.org.evil.example/1", "%PDF", [""]), (3, "https://export.arxiv.org/pdf/1", "<html>", []), (4, "http://export.arxiv.org/pdf/1", "%PDF", ["few words"])]
    df = rows(spark, "id int, url string, head string, pages array<string>", data)
    return df.select("id", T.downloadable(F.col("url"), F.col("head")).alias("may_store"), T.readable_pages(F.col("pages")).alias("text"))


@query(values("id words chars plain", [(1, "café|latte|naïve", " ca|caf|afé|fé | caf|café|afé | café|café ", "cafe latte naive"), (2, "", " x | a ", "x the"), (3, "", "", "")]))
def term_pieces(spark, sf_dir):
    df = rows(spark, "id int, s string, w string", [(1, "Café the LATTE naïve", "Café"), (2, "x the", "x a"), (3, "", "")])
    plain = F.regexp_replace(T.without_accents(F.lower("s")), "the l", "l")
    return df.select("id", listed(terms.tokens(F.col("s"))).alias("words"), listed(terms.char_grams(F.col("w"))).alias("chars"), plain.alias("plain"))


# Feeds and lines

ENTRIES = [
    """<entry xmlns:arxiv="http://arxiv.org/schemas/atom"><id>http://arxiv.org/abs/2607.00001v2</id><title>A
      title</title><summary> An  abstract. </summary><published>2026-07-03T00:10:00Z</published><updated>2026-07-04T01:00:00Z</updated>
      <author><name>Ann  Lee</name><arxiv:affiliation>MIT</arxiv:affiliation></author><author><name>Bo</name></author>
      <link href="http://arxiv.org/abs/2607.00001v2" rel="alternate" type="text/html"/><link title="pdf" href="http://arxiv.org/pdf/2607.00001v2" rel="related" type="application/pdf"/>
      <category term="cs.LG"/><category term="stat.ML"/><arxiv:primary_category term="cs.LG"/><arxiv:comment>5 pages</arxiv:comment><arxiv:doi>10.1/x</arxiv:doi></entry>""",
    """<entry><id>http://arxiv.org/abs/quant-ph/0201082v1</id><title>Old</title><summary>Older.</summary><published>2002-01-17T00:00:00Z</published>
      <updated>2002-01-17T00:00:00Z</updated><author><name>Cy</name></author><author><name> </name></author><category term="quant-ph"/></entry>""",
]


@query(
    values(
        "arxiv_id versioned_id title abstract authors categories primary_category submitted_date abs_url pdf_url doi comment store_id store_versioned version affiliations updated",
        [
            ("2607.00001", "2607.00001v2", "A title", "An abstract.", "Ann Lee|Bo", "cs.LG|stat.ML", "cs.LG", "2026-07-03", "http://arxiv.org/abs/2607.00001v2", "http://arxiv.org/pdf/2607.00001v2", "10.1/x", "5 pages",
             "2607.00001", "2607.00001v2", 2, '{"Ann Lee":["MIT"]}', "2026-07-04 01:00:00"),
            ("0201082", "0201082v1", "Old", "Older.", "Cy", "quant-ph", None, "2002-01-17", None, None, None, None, "quant-ph/0201082", "quant-ph/0201082v1", 1, "{}", "2002-01-17 00:00:00"),
        ],
    )
)
def feed_rows(spark, sf_dir):
    """Dataset rows and store rows of feed entries."""
    raw = rows(spark, "xml string", [(e,) for e in ENTRIES])
    entries = raw.select(F.from_xml("xml", feed.ENTRY, {"ignoreNamespace": "true"}).alias("e")).select("e.*")
    papers = feed.papers_of(entries).select("arxiv_id", "versioned_id", "title", "abstract", listed(F.col("authors")).alias("authors"), listed(F.col("categories")).alias("categories"), "primary_category", "submitted_date", "abs_url", "pdf_url", "doi", "comment")
    stored = feed.records_of(entries).select("title", F.col("arxiv_id").alias("store_id"), F.col("versioned_id").alias("store_versioned"), "version", F.to_json("affiliations").alias("affiliations"), F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))
    return papers.join(stored, "title")


GOOD = '{"arxiv_id":"%s","versioned_id":"%sv1","submitted_date":"%s","title":"t","abstract":"a","primary_category":"c"}'
LINES = [
    GOOD % (1, 1, "2026-07-03"),
    "",
    "[1]",
    "{",
    GOOD % (1, 1, "2026-07-03"),
    GOOD % (3, 3, "2026-7-3"),
    '{"arxiv_id":"4","versioned_id":"4v1","submitted_date":"2026-07-03","title":" ","abstract":"a","primary_category":"c"}',
    '{"title":"t","abstract":"a","primary_category":"c"}',
]


@query(
    values(
        "line strict lenient",
        [
            (1, None, None),
            (2, "not a JSON object", None),
            (3, "not a JSON object", "not a JSON object"),
            (4, "not a JSON object", "not a JSON object"),
            (5, "arxiv_id is repeated", "arxiv_id is repeated, first on line 1"),
            (6, "submitted_date is no date", None),
            (7, "title is missing", "title is missing"),
            (8, "arxiv_id is missing", None),
        ],
    )
)
def line_problems(spark, sf_dir):
    lines = rows(spark, "line long, value string", list(enumerate(LINES, 1)))
    strict = jsonl.paper_problems(lines).select("line", F.col("problem").alias("strict"))
    lenient = jsonl.example_problems(lines).select("line", F.col("problem").alias("lenient"))
    return strict.join(lenient, "line", "left")


# Requests, checkpoints, stores

REQUESTS: list[tuple[object, str]] = [
    ({"categories": ["cs.LG", "stat.ML", "cs.LG"], "max_results": 50, "lookback_hours": 72, "scan_revisions": False}, "cs.LG,stat.ML 50 72 False"),
    ({"categories": ["hep-th", "astro-ph.CO"]}, "hep-th,astro-ph.CO 200 24 True"),
    ([], "a request must be an object"),
    ({"categories": []}, "at least one category is needed"),
    ({"categories": ["cs.LG"] * 13}, "at most 12 categories are allowed"),
    ({"categories": ["cs.LG OR all:x"]}, "not a category: 'cs.LG OR all:x'"),
    ({"categories": ["cs.LG"], "max_results": True}, "max_results must be an integer"),
    ({"categories": ["cs.LG"], "max_results": 501}, "max_results must be between 1 and 500"),
    ({"categories": ["cs.LG"], "lookback_hours": 0}, "lookback_hours must be between 1 and 720"),
    ({"categories": ["cs.LG"], "scan_revisions": 1}, "scan_revisions must be true or false"),
]
LIMITS: list[tuple[object, str]] = [("7", "7"), (0, "1"), ("9999", "500"), (" 12 ", "12"), ("x", "limit must be an integer"), (True, "limit must be an integer")]


def _said(f, value: object) -> str:
    try:
        return str(f(value))
    except ValueError as e:
        return str(e)


@query(values("id outcome", [(i, out) for i, (_, out) in enumerate([*REQUESTS, *LIMITS])]))
def request_checks(spark, sf_dir):
    told = lambda r: "{} {} {} {}".format(",".join(r["categories"]), r["cap"], r["first_run_hours"], r["scan_revisions"])
    outcomes = [_said(lambda v: told(validation.fetch_request(v)), v) for v, _ in REQUESTS] + [_said(library.clamp_limit, v) for v, _ in LIMITS]
    return rows(spark, "id int, outcome string", list(enumerate(outcomes)))


@query(
    values(
        "state_key state_value start",
        [
            ("arxiv_submissions:cs.LG,cs.RO", "2024-06-23 12:00:00", "2024-06-22 12:00:00"),
            ("arxiv_revisions:cs.LG,cs.RO", "2024-06-23 12:00:00", "2024-06-22 12:00:00"),
            ("arxiv_submissions:cs.CV", "2024-06-20 12:00:00", "2024-06-19 12:00:00"),
            ("none", None, "2024-06-22 12:00:00"),
        ],
    )
)
def checkpoints(spark, sf_dir):
    """Two keys set at once over an older one; where a next run would start."""
    now, old = datetime(2024, 6, 23, 12), datetime(2024, 6, 20, 12)
    keys = [upsert.state_key(k, ["cs.RO", "cs.LG", "cs.RO"]) for k in (upsert.NEW_SUBMISSIONS, upsert.REVISIONS)]
    held = [(upsert.state_key(upsert.NEW_SUBMISSIONS, ["cs.CV"]), old, old), (upsert.state_key(upsert.NEW_SUBMISSIONS, ["cs.LG", "cs.RO"]), old, old)]
    state = upsert.advance(rows(spark, "state_key string, state_value timestamp, updated_at timestamp", held), dict.fromkeys(keys, now), now)
    state = state.select("state_key", "state_value").unionByName(rows(spark, "state_key string, state_value timestamp", [("none", None)]))
    start = F.coalesce(F.col("state_value"), F.lit(now)) - F.expr("interval 24 hours")
    seen = {True: upsert.window_start(None, now), False: upsert.window_start(old, now)}
    assert seen == {True: datetime(2024, 6, 22, 12), False: datetime(2024, 6, 19, 12)}
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return state.select("state_key", text("state_value").alias("state_value"), text(start).alias("start"))


def _store(spark: SparkSession) -> DataFrame:
    demo = feed.demo(spark)
    return upsert.upsert(rows(spark, PAPERS, []), demo)


@query(
    values(
        "arxiv_id versioned_id authors categories primary_category published_at updated_at pdf_url",
        [
            ("9999.00001", "9999.00001v1", "A. One|B. Two", "cs.RO|cs.LG", "cs.RO", "2026-06-01T00:00:00+00:00", "2026-06-01T00:00:00+00:00", None),
            ("9999.00002", "9999.00002v1", "B. Two", "cs.CV|cs.LG", "cs.CV", "2026-06-02T00:00:00+00:00", "2026-06-02T00:00:00+00:00", None),
        ],
    )
)
def demo_page(spark, sf_dir):
    """The demo rows through the store, as a page lists them."""
    page = library.shown(library.search(_store(spark), category="cs.LG"))
    return page.select("arxiv_id", "versioned_id", listed(F.col("authors")).alias("authors"), listed(F.col("categories")).alias("categories"), "primary_category", "published_at", "updated_at", "pdf_url")


@query(
    values(
        "step arxiv_id version pdf_path last_error changed_title first_seen last_seen",
        [
            ("again", "9999.00001", 1, "/x.pdf", None, False, 3, 9),
            ("again", "9999.00002", 1, None, "e" * 1000, False, 3, 9),
            ("newer", "9999.00001", 2, None, None, True, 3, 9),
            ("newer", "9999.00002", 2, None, None, True, 3, 9),
        ],
    )
)
def store_changes(spark, sf_dir):
    """A file and an error set, then the same versions once more, and then newer ones, which clear both."""
    held = upsert.set_error(upsert.set_file(_store(spark), "9999.00001", "pdf", "/x.pdf"), "9999.00002", "e" * 3000)
    held = upsert.set_file(upsert.set_error(held, "unknown", "no such paper"), "unknown", "text", "/y")
    later = feed.demo(spark, datetime(2026, 6, 9)).withColumn("title", F.lit("other"))
    newer = later.withColumns({"version": F.lit(2), "versioned_id": F.concat("arxiv_id", F.lit("v2"))})
    out = None
    for step, batch in (("again", later), ("newer", newer)):
        df = upsert.upsert(held, batch).select(F.lit(step).alias("step"), "arxiv_id", "version", "pdf_path", "last_error", (F.col("title") == "other").alias("changed_title"), F.dayofmonth("created_at").alias("first_seen"), F.dayofmonth("last_seen_at").alias("last_seen"))
        out = df if out is None else out.unionByName(df)
    return out


@query(values("arxiv_id source_versioned_id extractor extractor_version prompt_version features", [("a", "av2", "rules", "2", "p", "third"), ("b", "bv1", "rules", "1", None, "kept"), ("c", "cv1", "rules", "2", None, "new")]))
def feature_store(spark, sf_dir):
    """Of two new rows of a paper the last one replaces the stored one as a whole."""
    at = [datetime(2026, 7, 1), datetime(2026, 7, 2), datetime(2026, 7, 3)]
    stored = rows(spark, FEATURES, [("a", "av1", "rules", "1", None, at[0], "first"), ("b", "bv1", "rules", "1", None, at[0], "kept")])
    new = rows(spark, FEATURES, [("a", "av2", "rules", "2", None, at[1], "second"), ("a", "av2", "rules", "2", "p", at[2], "third"), ("c", "cv1", "rules", "2", None, at[1], "new")])
    return upsert.save_features(stored, new, "extracted_at").drop("extracted_at")


# Curation


@query(
    values(
        "id active words filled form category",
        [(1, 1, 3, 1, 3, "cs.LG"), (2, 0, 250, 0, 0, "(missing)"), (3, 0, 1, 3, 1, "(missing)"), (4, 1, 0, 0, 3, "x")],
    )
)
def paper_quality(spark, sf_dir):
    data = [
        (1, "a title of four", "some words here", "10.1/x", " ", None, ["a", "b"], "cs.LG"),
        (2, "short", "This was WITHDRAWN " + "word " * 300, None, None, None, None, ""),
        (3, "t", "x", "d", "j", "Retracted", ["a"], None),
        (4, None, None, None, None, None, ["a", "b", "c", "d"], "x"),
    ]
    df = rows(spark, "id int, title string, abstract string, doi string, journal_ref string, comment string, categories array<string>, primary_category string", data)
    active, words, filled, form, _ = curation.quality(key="title")
    return df.select("id", active.alias("active"), words.cast("int").alias("words"), filled.alias("filled"), form.alias("form"), curation.category_of().alias("category"))
