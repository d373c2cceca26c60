"""Secret scans in DataFrame functions only.

Patterns give the base spans. Long runs of key characters are scored besides by two character Markov models,
one of random strings and one of ordinary identifiers, as the mean log-likelihood ratio of their transitions; runs with a
sub-run of LEAST_SCORED characters or more above the threshold are spans of kind markov, so that a name or path before a
secret doesn't cancel it. A span is the whole run. The models are counted from labelled samples.

Positions come from split() and regexp_extract_all() with one pattern: a match starts after the pieces and matches
before it. Everything is computed row by row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.llm.common import running

# What the base kinds match. A hex or access run of the least length is the run itself.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Fewest characters of a scored sub-run, as many as RUN asks for.
LEAST_SCORED = 20
#: Least mean log-likelihood ratio, in nats for each transition, of a secret.
THRESHOLD = 0.6
MASK = "[SECRET]"
#: Code points in which a text is cut for masking.
CHUNK = 1024

# Parts of ordinary identifiers.
PARTS = (
    "account action active address admin amount application archive array attribute background balance batch binary block body "
    "boundary branch buffer build button cache callback category certificate channel character check child class client cluster code collection "
    "column command comment common component condition config connection constant container content context controller copy count counter create "
    "current customer database default delete dependency description detail device directory document domain download driver duration element "
    "email enable encoding engine entity entry environment error event example exception expected export expression extension factory failure feature "
    "field file filter final folder format function generate global graph group handler header height history image import include index "
    "information initial inner input instance integer interface internal invalid iterator keyword language latest layout length level library license "
    "limit linear listener local location logger machine manager mapping master maximum member memory message method minimum model module "
    "monitor network normal notification number object offset operation option order original output package parameter parent parser password path pattern "
    "payment percent performance permission person picture platform policy position previous primary priority private process product profile project "
    "property protocol provider public query queue random range reader receive record reference region register release remote render report "
    "repository request required reset resource response result return routine schema screen script search section security segment select sequence server "
    "service session setting shared signal simple single size snapshot source special standard start state status storage stream string structure "
    "style subject summary support switch symbol system table target template test thread timeout token total transaction transform type "
    "unique update upload user utility valid value variable vector version view visible warning widget width window worker writer "
    "and der die das und ein ist les des une que los las por con para the that with tion ment heit keit ung sch ver ber ent eur aux oir ción mente ado idad"
).split()


def labelled_samples(spark: SparkSession, n_random: int = 4000) -> DataFrame:
    """(text, is_random): n_random random strings in hex, base32 and base64 shapes, and joined identifier parts.

    The random ones are digests of running numbers, so the sample is the same each time; its size is bounded by
    n_random and the squared number of PARTS.
    """
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.base64(F.unhex(digest))
    shape = F.pmod("id", F.lit(4))
    text = F.when(shape == 0, digest).when(shape == 1, F.upper(base64)).otherwise(base64)
    random = spark.range(0, n_random, 1, 4).select(text.alias("text"), F.lit(True).alias("is_random"))
    words = spark.range(1).select(F.posexplode(F.split(F.lit(" ".join(PARTS)), " ")).alias("i", "w"))
    n = len(PARTS)
    left = words.select(F.col("i").alias("a"), F.col("w").alias("x"), F.explode(F.sequence(F.lit(1), F.lit(40), F.lit(3))).alias("step"))
    pairs = left.withColumn("i", F.pmod(F.col("a") * 7 + F.col("step") * 13, F.lit(n)).cast("int")).join(F.broadcast(words), "i").drop("i")
    third = words.select(F.col("i").alias("j"), F.col("w").alias("z"))
    triples = pairs.withColumn("j", F.pmod(F.col("a") * 3 + F.col("step") * 29, F.lit(n)).cast("int")).join(F.broadcast(third), "j")
    style = F.pmod(F.col("a") + F.col("step"), F.lit(7))
    name = (
        F.when(style == 0, F.concat_ws("_", "x", "w", "z"))
        .when(style == 1, F.concat("x", F.initcap("w"), F.initcap("z")))
        .when(style == 2, F.concat_ws("-", "x", "w", "z"))
        .when(style == 3, F.concat_ws("/", "x", "w", "z"))
        .when(style == 4, F.upper(F.concat_ws("_", "x", "w", "z")))
        .when(style == 5, F.concat_ws("_", "x", "w", F.concat("z", (F.col("step") % 10).cast("string"))))
        .otherwise(F.concat("x", "w", "z"))
    )
    return random.unionByName(triples.select(name.alias("text"), F.lit(False).alias("is_random")))


def _codes(text: Column) -> Column:
    """Places of a text's characters in the alphabet; others drop out."""
    return F.filter(F.transform(F.split(text, ""), lambda c: F.locate(c, F.lit(ALPHABET)) if isinstance(c, str) else F.instr(F.lit(ALPHABET), c)), lambda i: i > 0)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all transitions, random against ordinary, with add-one smoothing.

    samples: text, is_random. What comes to the driver is a number for each pair of alphabet characters.
    """
    codes = samples.select("is_random", _codes(F.col("text")).alias("c")).where(F.size("c") > 1)
    moves = codes.select("is_random", F.explode(F.expr("arrays_zip(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1))")).alias("m"))
    moves = moves.select("is_random", F.col("m")["0"].alias("a"), F.col("m")["1"].alias("b"))
    counts = moves.groupBy("a", "b").agg(F.count_if("is_random").alias("r"), F.count_if(~F.col("is_random")).alias("o")).collect()
    n = len(ALPHABET)
    r, o = ([[1.0] * n for _ in range(n)] for _ in range(2))
    for row in counts:
        r[row.a - 1][row.b - 1] += row.r
        o[row.a - 1][row.b - 1] += row.o
    from math import log

    return [round(log(r[a][b] / sum(r[a])) - log(o[a][b] / sum(o[a])), 4) for a in range(n) for b in range(n)]


def _is_secret(run: Column, model: Column, threshold: float) -> Column:
    """Whether a sub-run of LEAST_SCORED characters or more has a mean log-likelihood ratio of at least threshold.

    Sums are of the ratios less the threshold: a sub-run reaches it if its last sum isn't below its first one. held has the
    sums that a sub-run ending here is too short to start from, low the least of those before them.
    """
    n, least = len(ALPHABET), LEAST_SCORED - 1
    none = F.lit(float("inf"))
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("total"), F.array(F.lit(0.0)).alias("held"), none.alias("low"), F.lit(False).alias("hit"))

    def step(acc: Column, code: Column) -> Column:
        total = acc["total"] + F.get(model, (acc["last"] - 1) * n + code - 1) - F.lit(float(threshold))
        low = F.when(F.size(acc["held"]) == least, F.least(acc["low"], F.get(acc["held"], F.lit(0)))).otherwise(acc["low"])
        held = F.slice(F.array_append(acc["held"], total), F.greatest(F.size(acc["held"]) + 2 - least, F.lit(1)), F.lit(least))
        moved = F.struct(code.alias("last"), total.alias("total"), held.alias("held"), low.alias("low"), (acc["hit"] | (total >= low)).alias("hit"))
        first = F.struct(code.alias("last"), acc["total"].alias("total"), acc["held"].alias("held"), acc["low"].alias("low"), acc["hit"].alias("hit"))
        return F.when(acc["last"] > 0, moved).otherwise(first)

    return F.aggregate(_codes(run), start, step, lambda acc: acc["hit"])


def _spans(matches: Column, pieces: Column, kind: int) -> Column:
    """(start, kind, end) of each match, in code points."""
    empty = F.expr("array()").cast("array<struct<start:int,kind:int,end:int>>")
    sizes = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))
    spans = F.zip_with(running(sizes), matches, lambda end, m: F.struct((end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
    return F.when(F.size(matches) > 0, spans).otherwise(empty)


def _where(spans: Column, tests: Column) -> Column:
    """The spans whose place in tests holds true."""
    return F.transform(F.filter(F.arrays_zip(spans.alias("s"), tests.alias("t")), lambda x: x["t"]), lambda x: x["s"])


def find_secrets(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every row.

    Returns a row for each row of docs: doc_id, text, base (array of start, kind, end), spans (the same with kind markov),
    both in order of start and kind; kind is a place in KINDS; positions are code points, end exclusive.

    Null text is empty and has no spans. Rows are read one by one, so repeated rows and null ids need no care. Other
    columns are ignored.
    """
    model = train(labelled_samples(docs.sparkSession)) if model is None else model
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "markov": RUN}
    found = {k: F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in patterns.items()}
    df = df.select("doc_id", "text", *(m.alias(f"m_{k}") for k, m in found.items()))
    # Runs are scored first; only rows with a match are split.
    secret = F.transform("m_markov", lambda run: _is_secret(run, table, threshold))
    df = df.withColumn("ok_markov", secret)
    df = df.withColumn("ok_assign", F.when(F.size("m_assign") > 0, F.transform(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_LEAST)).otherwise(F.expr("array()").cast("array<boolean>")))
    pieces = lambda kind, some: F.when(some, F.split("text", patterns[kind], -1))
    some = {k: F.size(f"m_{k}") > 0 for k in KINDS} | {"markov": F.exists("ok_markov", lambda x: x)}
    df = df.select("*", *(pieces(k, some[k]).alias(f"p_{k}") for k in KINDS))
    none = F.expr("array()").cast("array<struct<start:int,kind:int,end:int>>")
    spans = {k: F.when(some[k], _spans(F.col(f"m_{k}"), F.col(f"p_{k}"), i)).otherwise(none) for i, k in enumerate(KINDS)}
    df = df.select("doc_id", "text", "ok_assign", "ok_markov", *(s.alias(f"s_{k}") for k, s in spans.items()))
    base = F.concat(_where(F.col("s_assign"), F.col("ok_assign")), "s_access", "s_hex")
    df = df.select("doc_id", "text", F.sort_array(base).alias("base"), F.when(some["markov"], _where(F.col("s_markov"), F.col("ok_markov"))).otherwise(none).alias("more"))
    return df.select("doc_id", "text", "base", F.when(F.size("more") > 0, F.sort_array(F.concat("base", "more"))).otherwise(F.col("base")).alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def _between(chunks: Column, low: Column, high: Column) -> Column:
    """The code points low to high (exclusive) of a text that is cut into CHUNKs; none of it is walked from its start."""
    a, b = F.floor(low / CHUNK).cast("int"), F.floor(high / CHUNK).cast("int")
    chunk = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
    front = F.substring(chunk(a), low % CHUNK + 1, F.least(high - low, F.lit(CHUNK)))
    middle = F.when(b - a > 1, F.concat_ws("", F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))))).otherwise("")
    return F.when(a == b, front).otherwise(F.concat(front, middle, F.substring(chunk(b), F.lit(1), high % CHUNK)))


def masked(text: str, spans: str, mask: str = MASK) -> Column:
    """The text with each run of overlapping or touching spans replaced by the mask; spans in order of start.

    A null text with spans doesn't occur; without spans the text stays as it is.
    """
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    # What is masked up to each span; a span that begins in it is part of the run before.
    reach = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    runs = F.transform(F.arrays_zip(F.col(spans).alias("s"), reach.alias("r")), lambda x, i: F.struct(x["s"]["start"].alias("start"), x["r"].alias("end"), i.alias("i")))

    def rendered(state: Column) -> Column:
        every, cut = state["runs"], state["chunks"]
        before = lambda i: F.coalesce(F.get(every, i - 1)["end"], F.lit(0))
        heads = F.filter(every, lambda x: (x["i"] == 0) | (x["start"] > before(x["i"])))
        parts = F.transform(heads, lambda x: F.concat(_between(cut, before(x["i"]), x["start"]), F.lit(mask)))
        return F.concat_ws("", parts, _between(cut, F.element_at(every, -1)["end"], F.length(F.col(text))))

    whole = F.get(F.transform(F.array(F.struct(runs.alias("runs"), chunks.alias("chunks"))), rendered), F.lit(0))
    return F.when(F.size(spans) > 0, whole).otherwise(F.col(text))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
