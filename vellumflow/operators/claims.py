"""Claims of an abstract with the envelope in which they hold, as column expressions.

A claim is a clause with a claim phrase and no mark of related work. Its details are all matches of patterns, pattern by
pattern. Patterns are Java's, with Unicode classes; the group that holds a detail is number 1, or 0 for the match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions.text import CLAUSE_END, NOT_ONLY, SENTENCE_END_TIGHT, firsts, fold, once, placed_matches, placed_pieces, squeeze, tidy, tight_sentences
from vellumflow.schemas import ENVELOPE

MOST_ENVELOPES, MOST_BOUNDARIES, LONGEST_CLAIM = 5, 3, 1000
DETAILS = ["comparators", "evaluation_contexts", "metrics", "reported_values", "effect_sizes", "uncertainty", "conditions"]

# What makes a claim, and what excludes one.
CLAIM = (
    r"(?iU)\b(?:we\s+(?:find|show|demonstrate|observe|report|establish|confirm|achieve)"
    r"|our\s+(?:results?|experiments?|analysis|evaluation)\s+(?:show|shows|indicate|indicates|suggest|suggests|demonstrate|demonstrates|reveal|reveals)"
    r"|(?:the\s+)?results?\s+(?:show|shows|indicate|indicates|suggest|suggests|demonstrate|demonstrates|reveal|reveals)"
    r"|(?:experiments?|evaluation)\s+(?:show|shows|demonstrate|demonstrates|confirm|confirms)"
    r"|our\s+(?:method|model|approach|framework|system)\s+(?:achieves?|attains?|outperforms?|improves?|reduces?|increases?|yields?))\b"
)
RELATED = r"(?iU)\b(?:prior work|previous work|related work|earlier work|other studies)\b"
BOUNDARY = (
    r"(?iU)\b(?:limitations?|limited by|restricted to|fails? to|struggl(?:e|es|ed) to|cannot|does not generalize|do not generalize"
    r"|future work|remains? (?:unclear|unknown|challenging))\b"
)
NOT_OWN_BOUNDARY = (
    r"(?iU)\b(?:to address (?:this|that|the|these) limitations?|overcom(?:e|es|ing) (?:this|that|the|these) limitations?"
    r"|(?:existing|prior|previous) (?:methods?|approaches?|work))\b"
)
# Cues of a claim's type, first match counts, and of its direction.
TYPES = {
    "causal_language": r"(?iU)\b(?:causes?|caused|leads? to|resulted? in|drives?|due to|because of)\b",
    "associational": r"(?iU)\b(?:associated with|correlat(?:e|es|ed|ion)|linked to|relationship between)\b",
    "predictive": r"(?iU)\b(?:predict(?:s|ed|ion)?|forecast(?:s|ed|ing)?|prognostic)\b",
    "comparative": (
        r"(?iU)\b(?:compared (?:with|to)|relative to|versus|vs\.?|outperform(?:s|ed)?|underperform(?:s|ed)?"
        r"|improv(?:e|es|ed|ement)|higher|lower|better|worse)\b"
    ),
}
NO_IMPROVEMENT = r"(?iU)\bno improvement\b"
NEGATIVE = r"(?iU)\b(?:no improvement|does not|do not|did not|fails? to|underperform(?:s|ed)?|worse)\b"
POSITIVE = (
    r"(?iU)\b(?:outperform(?:s|ed)?|improv(?:e|es|ed|ement)|better|higher (?:accuracy|score|performance)"
    r"|lower (?:error|loss|latency)|reduc(?:e|es|ed|tion)|increas(?:e|es|ed))\b"
)
# Details.
NOT_ONLY_PAIR = (
    r"(?iU)\boutperform(?:s|ed)?\s+not only\s+([^,;:.]+?)\s+but (?:also|even)\s+([^,;:.]+?)(?=\s+(?:on|in|under|by|with)\b|[,.]|$)"
)
COMPARATORS = (
    r"(?iU)\b(?:compared (?:with|to)|relative to|versus|vs\.?)\s+([^,;:.()]{2,100}?)(?=\s+(?:and|but)\s+(?:can\s+)?(?:outperform|underperform|improve)\b"
    r"|\s+(?:while|whereas|but)\b|\s+and\s+(?:achieving|requiring|reducing|remaining|using)\b|\s+(?:on|in|under|across|with|using)\b|[,;:.()]|$)",
    r"(?iU)\boutperform(?:s|ed)?\s+([^,;:.]{2,80}?)(?=\s+(?:on|in|under|by|with|while|whereas|using|across)\b"
    r"|\s+and\s+(?:achieving|requiring|reducing|remaining|using)\b|[,.]|$)",
)
METRIC_NAMES = (
    r"(?iU)\b(?:accuracy|F1(?:[- ]score)?|precision|recall|AUROC|ROC-AUC|AUC|BLEU|ROUGE|perplexity|RMSE|MAE|MSE|error rate|success rate"
    r"|mortality|hazard ratio|odds ratio|correlation|throughput|latency)\b",
)
VALUES = (
    r"(?iU)(\{?[+-]?\d+(?:\.\d+)?\\?%\}?|[+-]?\d+(?:\.\d+)?\s*(?:percent(?:age)?(?: points?)?|pp\b|-?fold\b|×))",
    r"(?iU)((?<![\w.])\d+(?:\.\d+)?(?:\s*[-–]\s*\d+(?:\.\d+)?)?\s*[x×])\b",
    r"(?iU)(\bfactor of\s+\d+(?:\.\d+)?)\b",
    r"(?iU)(\b\d+(?:\.\d+)?\s*(?:dB|mm|cm|km|ms|ns|GHz|MHz|kHz|MB|GB|TB))\b",
    r"(?iU)\b(?:accuracy|F1(?:[- ]score)?|AUROC|ROC-AUC|AUC|BLEU|ROUGE|perplexity|RMSE|MAE|MSE)\s*[:=]?\s*(\d+(?:\.\d+)?)\b",
)
EFFECTS = (
    r"(?iU)(?:(?<!\w)[+-]?\d+(?:\.\d+)?\s*(?:percentage points?|pp\b)"
    r"|\b(?:by|(?:improvement|increase|decrease|reduction) of)\s+[+-]?\d+(?:\.\d+)?\s*(?:%|percent|fold)(?:\s+to\s+[+-]?\d+(?:\.\d+)?\s*(?:%|percent|fold))?"
    r"|\b\d+(?:\.\d+)?-fold\s+(?:speedup|improvement|increase|reduction)"
    r"|\b\d+(?:\.\d+)?\s*[-–]\s*\d+(?:\.\d+)?\s*[x×]\s+faster"
    r"|\bfactor of\s+\d+(?:\.\d+)?"
    r"|\{?\d+(?:\.\d+)?\\?%\}?\s+(?:gain|improvement|increase|reduction)"
    r"|\b\d+(?:\.\d+)?\s+percent(?:\s+to\s+\d+(?:\.\d+)?\s+percent)?\s+(?:improvements?|increases?|decreases?|reductions?))",
)
UNCERTAINTY = (
    r"(?iU)\bp\s*[<=>]\s*(?:\d+(?:\.\d+)?(?:e[+-]?\d+)?|\.\d+)\b",
    r"(?iU)\b\d+(?:\.\d+)?%\s*(?:CI|confidence interval)\b(?:\s*(?:of|[:=])?\s*\[?\(?[+-]?\d+(?:\.\d+)?\s*(?:to|[-–,])\s*[+-]?\d+(?:\.\d+)?\)?\]?)?",
    r"(?U)(?<!\w)[+-]?\d+(?:\.\d+)?\s*(?:%|percent)?\s*\$?\s*(?:±|\\pm)\s*\$?\s*[+-]?\d+(?:\.\d+)?\s*(?:%|percent)?",
)
CONDITIONS = (
    r"(?iU)\b(under|across|when|within)\s+([^;.()]{3,180}?)(?=\s*\(|[;.]|,\s+(?=(?:and\s+(?:it|they|this|that|we|our)"
    r"|we|our|the|this|these|results?|experiments?|while|whereas|but)\b)|\s+and\s+(?=(?:we|our|(?:the\s+)?results?|experiments?)\b)|$)"
)
CONTEXTS = (
    r"(?U)\b(?:on|using)\s+(?:the\s+)?([A-Z][A-Za-z0-9]*(?:[-_.][A-Za-z0-9]+)*(?:\s+[A-Z][A-Za-z0-9]*(?:[-_.][A-Za-z0-9]+)*){0,3})"
    r"(?=\s+(?:dataset|benchmark|test set|cohort)\b|\s+(?:under|with|using)\b|[,.;()]|$)",
    r"(?iU)\b(\d[\d,]*\s+(?:patients?|participants?|subjects?|samples?|cases?))\b",
)


def _all(text: Column, patterns: tuple[str, ...], group: int) -> Column:
    return tidy(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(group)) for p in patterns)))


def claim_type(text: Column) -> Column:
    out = F.lit("descriptive")
    for name, cue in reversed(TYPES.items()):
        out = F.when(text.rlike(cue), name).otherwise(out)
    return out


def direction(text: Column) -> Column:
    bad, good = text.rlike(NEGATIVE), text.rlike(POSITIVE)
    return F.when(text.rlike(NO_IMPROVEMENT), "negative").when(bad & good, "mixed").when(bad, "negative").when(good, "positive").otherwise("unclear")


def comparators(text: Column) -> Column:
    pair = [F.get(F.regexp_extract_all(text, F.lit(NOT_ONLY_PAIR), F.lit(i)), F.lit(0)) for i in (1, 2)]
    return F.when(text.rlike(NOT_ONLY_PAIR), tidy(F.array(*pair))).otherwise(_all(text, COMPARATORS, 1))


def conditions(text: Column) -> Column:
    both = [F.regexp_extract_all(text, F.lit(CONDITIONS), F.lit(i)) for i in (1, 2)]
    return tidy(F.zip_with(*both, lambda prefix, value: F.concat_ws(" ", prefix, value)))


def boundaries(clean: Column) -> Column:
    """The first sentences that limit the whole paper."""
    return F.slice(tidy(F.filter(tight_sentences(clean), lambda s: s.rlike(BOUNDARY) & ~s.rlike(NOT_OWN_BOUNDARY))), 1, MOST_BOUNDARIES)


def claims(clean: Column) -> Column:
    """(index of the sentence, claim, its place in the text): distinct without case, in order, the first MOST_ENVELOPES.

    Sentences, clauses and claims are nested spans of the squeezed text.
    """

    def of_sentence(s: Column, i: Column) -> Column:
        whole = F.array(F.struct(s["value"].alias("value"), F.lit(0).alias("start")))
        parts = F.when(s["value"].rlike(NOT_ONLY), whole).otherwise(placed_pieces(s["value"], CLAUSE_END))

        def of_clause(c: Column) -> Column:
            left = F.regexp_replace(c["value"], r"(?U)^\s+", "")
            start = s["start"] + c["start"] + F.length(c["value"]) - F.length(left)
            return F.struct(i.alias("sentence_index"), F.regexp_replace(left, r"(?U)\s+$", "").alias("claim"), start.alias("start"))

        return F.transform(parts, of_clause)

    # A text's sentences are cut into clauses only where a claim phrase is.
    told = F.filter(F.transform(placed_pieces(clean, SENTENCE_END_TIGHT), lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: x["s"]["value"].rlike(CLAIM))
    found = F.filter(F.flatten(F.transform(told, lambda x: of_sentence(x["s"], x["i"]))), lambda x: (x["claim"] != "") & ~x["claim"].rlike(RELATED) & x["claim"].rlike(CLAIM))
    return F.slice(firsts(found, lambda x: fold(x["claim"])), 1, MOST_ENVELOPES)


#: Patterns of each detail, and the group that holds it; a group other than 0 ends its match.
DETAIL_PATTERNS = {
    "comparators": (COMPARATORS, 1),
    "evaluation_contexts": (CONTEXTS, 1),
    "metrics": (METRIC_NAMES, 0),
    "reported_values": (VALUES, 1),
    "effect_sizes": (EFFECTS, 0),
    "uncertainty": (UNCERTAINTY, 0),
    "conditions": ((CONDITIONS,), 0),
}


def claim_spans(papers: DataFrame, key: str, abstract: str = "abstract") -> DataFrame:
    """Claims and their details as spans: key, claim_index, kind, value, start, end.

    kind is `claim` or a detail; a detail lies inside its claim. Positions are code points of the squeezed abstract, ends exclusive.
    All matches of a detail's patterns are there, as they stand, also those that an envelope has once only.
    """
    clean = squeeze(F.coalesce(F.col(abstract), F.lit("")))
    found = papers.select(F.col(key).alias("key"), F.posexplode(once(clean, lambda c: F.when(c.rlike(CLAIM), claims(c)))).alias("claim_index", "c"))
    text, at = F.col("c.claim"), F.col("c.start")
    whole = F.struct(F.lit("claim").alias("kind"), text.alias("value"), at.alias("start"))
    details = [_detail(kind, text, at, p, group) for kind, (patterns, group) in DETAIL_PATTERNS.items() for p in patterns]
    rows = found.select("key", "claim_index", F.explode(F.concat(F.array(whole), *details)).alias("x"))
    return rows.select(F.col("key").alias(key), "claim_index", "x.kind", "x.value", "x.start", (F.col("x.start") + F.length("x.value")).alias("end"))


def _detail(kind: str, text: Column, at: Column, pattern: str, group: int) -> Column:
    return F.transform(placed_matches(text, pattern, group), lambda m: F.struct(F.lit(kind).alias("kind"), m["value"].alias("value"), (at + m["start"]).alias("start")))


def _envelope(c: Column, limits: Column) -> Column:
    text = c["claim"]
    details = F.struct(
        comparators(text).alias("comparators"),
        _all(text, CONTEXTS, 1).alias("evaluation_contexts"),
        _all(text, METRIC_NAMES, 0).alias("metrics"),
        _all(text, VALUES, 1).alias("reported_values"),
        _all(text, EFFECTS, 0).alias("effect_sizes"),
        _all(text, UNCERTAINTY, 0).alias("uncertainty"),
        conditions(text).alias("conditions"),
    )

    def record(d: Column) -> Column:
        some = {k: F.size(d[k]) > 0 for k in DETAILS}
        groups = [some["comparators"], some["evaluation_contexts"], some["metrics"], some["reported_values"] | some["effect_sizes"], some["uncertainty"], some["conditions"]]
        supported = sum((g.cast("int") for g in groups[1:]), groups[0].cast("int"))
        return F.struct(
            text.alias("claim"),
            claim_type(text).alias("claim_type"),
            direction(text).alias("direction"),
            *(d[k].alias(k) for k in DETAILS),
            limits.alias("paper_level_boundaries"),
            F.struct(F.lit("abstract").alias("source"), c["sentence_index"].alias("sentence_index"), text.alias("statement")).alias("evidence"),
            F.least(F.lit(0.55) + supported * F.lit(0.05), F.lit(0.9)).alias("confidence"),
        ).cast(ENVELOPE)

    return once(details, record)


def envelopes(abstract: Column) -> Column:
    """The claims of an abstract with their details; a claim over LONGEST_CLAIM characters is an error.

    Text, claims and the paper's limits are bound, so that each is found once, and limits only where there are claims.
    """
    too_long = F.raise_error(F.lit("a claim is too long")).cast("array<struct<sentence_index:int,claim:string,start:int>>")
    none = F.array().cast(f"array<{ENVELOPE}>")

    def of_claims(found: Column, clean: Column) -> Column:
        checked = F.when(F.exists(found, lambda c: F.length(c["claim"]) > LONGEST_CLAIM), too_long).otherwise(found)
        return F.when(F.size(found) > 0, once(boundaries(clean), lambda limits: F.transform(checked, lambda c: _envelope(c, limits)))).otherwise(none)

    def of_text(clean: Column) -> Column:
        return F.when(clean.rlike(CLAIM), once(claims(clean), lambda found: of_claims(found, clean))).otherwise(none)

    return once(squeeze(F.coalesce(abstract, F.lit(""))), of_text)


def with_claims(papers: DataFrame, abstract: str = "abstract") -> DataFrame:
    """papers with validity_envelopes and status: extracted, or no_supported_claim where there are none."""
    df = papers.withColumn("validity_envelopes", envelopes(F.col(abstract)))
    return df.withColumn("status", F.when(F.size("validity_envelopes") > 0, "extracted").otherwise("no_supported_claim"))


def violations(papers: DataFrame) -> DataFrame:
    """Rows whose status doesn't say whether they have envelopes, or whose claim isn't in the abstract."""
    stray = F.exists("validity_envelopes", lambda e: ~squeeze(F.col("abstract")).contains(e["claim"]))
    return papers.where(((F.size("validity_envelopes") > 0) != (F.col("status") == "extracted")) | stray)
