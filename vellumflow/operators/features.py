"""Rule-based features of papers with their evidence, as column expressions.

Values and evidence are spans that one automaton finds (operators/spans.py). `matched` is the same for one small vocabulary as a
column expression: a longer alias takes its span out of the text, so that no shorter one can match inside, and what is left of
the text is bound at each length of aliases.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions.text import clauses, code_urls, contains_any, empty_strings, first_sentence, fold, marked_statements, once, sentences, squeeze_but_newlines
from vellumflow.operators.claims import envelopes
from vellumflow.operators.spans import RELATED_WORK, alias_table, with_feature_terms

Vocabulary = dict[str, list[str]]

# Vocabularies (label: aliases), in output order.
METHODS: Vocabulary = {
    "transformer": ["transformer", "attention model"],
    "diffusion model": ["diffusion model", "score-based model", "denoising diffusion"],
    "large language model": ["large language model", "llm"],
    "graph neural network": ["graph neural network", "gnn"],
    "convolutional neural network": ["convolutional neural network", "cnn"],
    "reinforcement learning": ["reinforcement learning", "policy optimization"],
    "contrastive learning": ["contrastive learning", "contrastive objective"],
    "variational autoencoder": ["variational autoencoder", "vae"],
    "generative adversarial network": ["generative adversarial network", "gan"],
    "retrieval-augmented generation": ["retrieval-augmented generation", "rag"],
    "random forest": ["random forest", "random forests"],
}
DATASETS: Vocabulary = {
    "MNIST": ["mnist"],
    "Fashion-MNIST": ["fashion-mnist", "fashion mnist", "fashionmnist"],
    "CIFAR-10": ["cifar-10", "cifar10"],
    "CIFAR-100": ["cifar-100", "cifar100"],
    "ImageNet": ["imagenet"],
    "MS COCO": ["ms coco", "coco dataset"],
    "GLUE": ["glue benchmark"],
    "SuperGLUE": ["superglue"],
    "WikiText": ["wikitext"],
    "LibriSpeech": ["librispeech"],
    "HumanEval": ["humaneval"],
    "MMLU": ["mmlu"],
}
METRICS: Vocabulary = {
    "accuracy": ["accuracy"],
    "F1 score": ["f1 score", "f1-score", "macro-f1", "micro-f1"],
    "precision": ["precision"],
    "recall": ["recall"],
    "AUROC": ["auroc", "roc-auc", "area under the roc"],
    "BLEU": ["bleu"],
    "ROUGE": ["rouge"],
    "perplexity": ["perplexity"],
    "mean squared error": ["mean squared error", "mse"],
    "Fréchet inception distance": ["fréchet inception distance", "fid"],
}
TASKS: Vocabulary = {
    "classification": ["classification", "classify"],
    "regression": ["regression"],
    "generation": ["generation", "generate samples", "text generation"],
    "object detection": ["object detection"],
    "segmentation": ["segmentation"],
    "machine translation": ["machine translation", "translation"],
    "question answering": ["question answering"],
    "anomaly detection": ["anomaly detection", "outlier detection"],
    "robot control": ["robot control", "robot manipulation", "robotic manipulation"],
    "change-point detection": ["change-point detection", "change point detection"],
}
DOMAINS: Vocabulary = {
    "computer vision": ["computer vision", "image"],
    "natural language processing": ["natural language processing", "language model", "text"],
    "robotics": ["robot", "robotics", "manipulation"],
    "healthcare": ["healthcare", "medical", "clinical"],
    "time series": ["time series", "temporal data"],
    "graphs": ["graph-structured", "graph data", "network data"],
}
# Phrases that mark contributions and limitations.
CONTRIBUTIONS = ("our contribution", "our main contribution", "we contribute", "this paper contributes")
LIMITATIONS = ("a limitation is", "limitations are", "our limitation", "we are limited by", "limited to")
NOT_LIMITED = r"(?iU)\b(?:not|never)\s+limited to\b"
NO_SUMMARY = "No abstract available."
CONFIDENCE = 0.35
TAKEN = ""


def _whole_words(names: list[str]) -> str:
    return rf"(?U)(?<!\w)(?:{'|'.join(map(re.escape, names))})(?!\w)"


def _in_order(vocabulary: Vocabulary, labels: Column) -> Column:
    return once(labels, lambda found: F.filter(F.array(*map(F.lit, vocabulary)), lambda label: F.array_contains(found, label)))


def matched(text: Column, vocabulary: Vocabulary) -> Column:
    """Labels whose aliases match as whole words, in vocabulary order."""
    label_of = {a.lower(): label for label, aliases in vocabulary.items() for a in aliases}
    sizes = sorted({len(a) for a in label_of}, reverse=True)

    def found(rest: Column, left: list[int]) -> Column:
        pattern = _whole_words([a for a in label_of if len(a) == left[0]])
        hits = F.regexp_extract_all(rest, F.lit(pattern), F.lit(0))
        if len(left) == 1:
            return hits
        return F.concat(hits, once(F.regexp_replace(rest, pattern, TAKEN), lambda r: found(r, left[1:])))

    some = once(fold(text), lambda t: F.when(t.rlike(_whole_words(list(label_of))), found(t, sizes)).otherwise(empty_strings()))
    table = F.create_map(*(F.lit(x) for pair in label_of.items() for x in pair))
    return F.coalesce(_in_order(vocabulary, F.transform(some, lambda a: F.element_at(table, a))), empty_strings())


def _unmarked(clause: Column) -> Column:
    return ~contains_any(clause, RELATED_WORK)


def body_clauses(body: Column) -> Column:
    return F.flatten(F.transform(sentences(squeeze_but_newlines(body)), clauses))


def own_clauses(body: Column) -> Column:
    """The clauses without a mark of related work, a line each. No alias reaches over the end of a line."""
    return F.concat_ws("\n", F.filter(body_clauses(body), _unmarked))


def used(body: Column, vocabulary: Vocabulary) -> Column:
    """Labels that some clause without a mark of related work holds."""
    return matched(own_clauses(body), vocabulary)


def titled_or_used(title: Column, body: Column, vocabulary: Vocabulary) -> Column:
    return matched(F.concat_ws("\n", title, own_clauses(body)), vocabulary)


VOCABULARIES: dict[str, Vocabulary] = {"research_tasks": TASKS, "methods": METHODS, "datasets": DATASETS, "metrics": METRICS, "domains": DOMAINS}
#: Values of these count in the title and in clauses without a mark of related work.
USAGE = ("methods", "datasets", "metrics")


def aliases_of(papers: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """The five vocabularies as a table, with further rows of the same columns."""
    own = alias_table(papers.sparkSession, VOCABULARIES)
    return own if more is None else own.unionByName(more.select("vocabulary", "label", "place", "alias"))


def _values(terms: str, field: str) -> Column:
    """The labels of a field's terms, each once, in the vocabulary's order."""
    some = F.filter(terms, lambda x: (x["vocabulary"] == field) & x["used"])
    return F.transform(F.array_sort(F.array_distinct(F.transform(some, lambda x: F.struct(x["place"].alias("place"), x["label"].alias("label"))))), lambda x: x["label"])


def _evidence(terms: str, field: str) -> Column:
    """One statement for each value that has any, in the vocabulary's order."""
    some = F.filter(terms, lambda x: (x["vocabulary"] == field) & x["statement"].isNotNull())
    rows = F.array_sort(F.transform(some, lambda x: F.struct(x["place"].alias("place"), x["label"].alias("value"), x["statement"].alias("statement"))))
    return F.transform(rows, lambda x: F.struct(F.lit(field).alias("field"), x["value"].alias("value"), x["statement"].alias("statement")))


def with_features(papers: DataFrame, title: str = "title", abstract: str = "abstract", paper_text: str = "paper_text", aliases: DataFrame | None = None) -> DataFrame:
    """papers with a struct `features`: summary, terms, statements, URLs, evidence and claim envelopes.

    aliases: further rows of vocabulary (a field of terms), label, place and alias, any number of them.
    """
    t, a, p = (F.coalesce(F.col(c), F.lit("")) for c in (title, abstract, paper_text))
    df = papers.withColumns({"_t": t, "_a": a, "_b": F.concat(a, F.lit("\n"), p)})
    df = with_feature_terms(df, aliases_of(papers, aliases), USAGE, "_t", "_b", "_terms")
    t, a, b = F.col("_t"), F.col("_a"), F.col("_b")
    whole = F.concat(t, F.lit("\n"), b)
    values = {field: _values("_terms", field) for field in VOCABULARIES}
    df = df.withColumns({**values, "contributions": marked_statements(b, CONTRIBUTIONS), "limitations": marked_statements(b, LIMITATIONS, NOT_LIMITED)})
    said = lambda f: F.transform(f, lambda v: F.struct(F.lit(f).alias("field"), v.alias("value"), v.alias("statement")))
    evidence = F.concat(*(_evidence("_terms", field) for field in VOCABULARIES), said("contributions"), said("limitations"))
    summary = first_sentence(a)
    from vellumflow.operators.terms import keywords

    record = F.struct(
        F.when(summary == "", NO_SUMMARY).otherwise(summary).alias("one_sentence_summary"),
        *VOCABULARIES,
        "contributions",
        "limitations",
        code_urls(whole).alias("code_urls"),
        keywords(F.concat_ws(" ", t, a)).alias("keywords"),
        evidence.alias("evidence"),
        envelopes(a).alias("validity_envelopes"),
        F.lit(CONFIDENCE).alias("confidence"),
    )
    return df.withColumn("features", record).select(*papers.columns, "features")


Extractor = Callable[[DataFrame], DataFrame]
EXTRACTORS: dict[str, Extractor] = {"rules": with_features}


def extractor(name: str) -> Extractor:
    """A registered extractor: papers in, papers with `features` out."""
    if name not in EXTRACTORS:
        raise ValueError(f"unknown extractor: {name}")
    return EXTRACTORS[name]


def remote_extractor(ask: Callable[[str], str], schema: str, prompt: str = "prompt") -> Extractor:
    """An extractor that sends each row's prompt column to a service and reads its JSON answer by the schema.

    `ask` runs on the executors, Arrow batch by batch; a null or unreadable answer is an error.
    """

    def run(papers: DataFrame) -> DataFrame:
        @F.pandas_udf("string")
        def answers(prompts):
            return prompts.map(ask)

        parsed = F.from_json(answers(prompt), schema, {"mode": "FAILFAST"})
        return papers.withColumn("features", F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.lit("the service gave no features"))))

    return run


