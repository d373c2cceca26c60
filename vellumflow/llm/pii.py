"""Personal data by candidate generators and boosted trees, in DataFrame functions only.

Patterns give the base spans. Generators of high recall propose more: addresses spelt out, phone numbers without a plus,
bank accounts, national ids and network addresses. Their spans may overlap. Features of a candidate's form and of the text
around it go through gradient-boosted trees, which are trained on a labelled sample and then written out as one expression,
so that texts are neither exploded nor shuffled. A candidate is redacted if its probability reaches its kind's threshold,
which held-out rows of the sample calibrate for precision. Candidates that overlap become one span, of the likeliest's kind.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumflow.llm.common import running
from vellumflow.llm.secret_scan import _spans, _where, masked

# What the base kinds match. A run that fails from its start fails from all its places, so that each run is
# tried once; repeated groups are possessive, as nothing after them could need what they took.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"^{PART}\.{PART}\.{PART}\.{PART}$"

#: What is proposed besides.
GENERATORS = {
    "address": (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+(?:\x20@\x20|\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?|\x20(?:at|AT)\x20)[A-Za-z0-9-]{1,63}+"
        r"(?:(?:\.|\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]{1,63}+)++"
    ),
    "number": r"(?<![\p{L}0-9_.,+/:-])\(?[0-9]++(?:[\x20()./-]{1,3}+[0-9]++)*+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "identity": r"(?<![0-9A-Za-z.-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z-])",
    "host": r"(?<![0-9A-Za-z:.-])(?:(?:[0-9A-Fa-f]{2}[:-]){5}+[0-9A-Fa-f]{2}|[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){3,7}+)(?![0-9A-Za-z:-])",
}
KINDS = [*BASE, *GENERATORS]
FIRST = len(BASE)
#: Characters before and after a candidate that are read.
BEFORE, AFTER = 40, 24
#: Digits of a number that can be a phone number.
DIGITS = (7, 15)
MASK = "[PERSONAL]"

# Words that speak for a kind of personal data, and for other numbers.
CUES = {
    "phone": r"(?i)(?:\btel|phone|\bcall|mobile|\bcell|\bfax|whatsapp|telefon|téléphone|teléfono|handy|\bruf|appele|llam|\bsms\b|dial)",
    "mail": r"(?i)(?:e-?mail|\bmail|contact|kontakt|correo|courriel|write to|reach|schreib|écri|escrib|address)",
    "id": r"(?i)(?:\bssn\b|social security|iban|account|konto|compte|cuenta|passport|national id|sozialversicherung|taxpayer|\bnir\b)",
    "net": r"(?i)(?:\bip\b|ipv6|\bmac\b|\bhost|client|device|login|logged in|adapter)",
    "other": r"(?i)(?:isbn|order|invoice|version|\bpages?\b|\bpp\b|\bref|item|part no|serial|\bdoi\b|\bvol|chapter|section|price|cost|\beur\b|\busd\b|[€$£]|\bdate|since|ratio|score|time|build)",
}
UNIT = r"(?i)^\x20?(?:km|kg|%|eur\b|usd\b|[€$£]|people|years|pages|mm\b|cm\b|times|[ap]m\b|°|units|bytes|points)"
DATE = r"^(?:(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[-/ ](?:19|20)[0-9]{2})(?![0-9])"


def _is(condition: Column) -> Column:
    return condition.cast("double")


def _remainder(text: Column) -> Column:
    """An account number's remainder by 97: letters count from 10, the first four characters come last."""
    plain = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))
    places = F.sequence(F.lit(1), F.length(turned))

    def step(acc: Column, i: Column) -> Column:
        value = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(turned, i, F.lit(1))) - 1
        return F.when(value < 10, (acc * 10 + value) % 97).otherwise((acc * 100 + value) % 97)

    return F.aggregate(places, F.lit(0), step)


def features(kind: Column, text: Column, before: Column, after: Column) -> Column:
    """What the trees see of a candidate: an array of doubles."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    last = F.regexp_extract(text, "([0-9]*+)[^0-9]*$", 1)
    at = F.when(text.contains("@"), 3.0).when(text.rlike(r"(?i)[\[({]\x20?at"), 2.0).when(text.rlike(r"(?i)\x20at\x20"), 1.0).otherwise(0.0)
    dot = F.when(text.rlike(r"(?i)[\[({]\x20?dot"), 2.0).when(text.rlike(r"(?i)\x20dot\x20"), 1.0).otherwise(0.0)
    valid = F.when(kind == KINDS.index("account"), _is(_remainder(text) == 1)).otherwise(0.0)
    return F.array(
        kind.cast("double"),
        F.length(text).cast("double"),
        F.length(digits).cast("double"),
        F.length(F.regexp_replace(text, "[0-9A-Za-z]", "")).cast("double"),
        F.size(F.split(text, "[^0-9]+")).cast("double"),
        F.length(last).cast("double"),
        _is(text.startswith("(")),
        _is(digits.startswith("0")),
        _is(text.rlike(DATE)),
        valid,
        at,
        dot,
        _is(text.rlike(r"(?i)[a-z]{2,24}$")),
        F.length(F.regexp_replace(text, "[^A-Fa-f]", "")).cast("double"),
        _is(text.contains("::") | text.rlike("^(?:[0-9A-Fa-f]{2}[:-]){5}")),
        *(_is(before.rlike(p)) for p in CUES.values()),
        _is(after.rlike(UNIT)),
    )


def labelled_sample(spark: SparkSession, n: int = 6000) -> DataFrame:
    """(id, kind, text, before, after, label): n candidates made from hashes of running numbers, the same each time.

    Label 1 is personal data: what a cue introduces, or what its form alone gives away. n bounds the sample.
    """
    rows = spark.range(0, n, 1, 2)
    i = F.col("id")
    code = lambda salt, most: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(most))
    pick = lambda salt, values: F.get(F.array(*(F.lit(v) for v in values)), code(salt, len(values)).cast("int"))
    digits = lambda salt, k: F.lpad(code(salt, 10**k).cast("string"), k, "0")
    hexes = lambda salt, k: F.substring(F.sha2(F.concat(i.cast("string"), F.lit(salt)), 256), 1, k)
    join = F.concat
    neutral = ["", "and then ", "it was ", "which is ", "of the ", "und dann ", "est de ", "por la ", "in the end ", "with ", "about ", "(see ", "the table has "]
    cues = {
        "address": ["Contact: ", "e-mail ", "Write to ", "Kontakt: ", "correo: ", "you can reach me: ", "my address is ", "courriel : "],
        "number": ["Tel. ", "phone: ", "call me on ", "mobile ", "Telefon: ", "téléphone ", "teléfono: ", "Fax ", "WhatsApp ", "Handy "],
        "account": ["IBAN ", "account: ", "Konto ", "pay into account ", "cuenta ", "compte n° "],
        "identity": ["SSN ", "social security number: ", "ssn: ", "national id ", "taxpayer "],
        "host": ["client ", "from host ", "MAC ", "IP ", "logged in from ", "device "],
    }
    others = ["order ", "ISBN ", "version ", "pages ", "ref. ", "invoice ", "price $", "item ", "since ", "score ", "part no. ", "time ", "€ ", "vol. ", "ratio "]
    first, second = pick("u", ["anna", "j.miller", "max", "info", "lucie", "p_garcia", "tom", "contact"]), pick("d", ["example", "mail7", "uni-berlin", "posteo", "work", "home", "company"])
    tld = pick("t", ["com", "org", "de", "fr", "net", "es", "co"])
    shy, dot = pick("a", [" [at] ", "(at)", " (at) ", " @ ", " AT ", " at ", "[at]"]), pick("o", [".", " [dot] ", " dot ", "(dot)", "."])
    phones = [
        join(F.lit("("), digits(1, 3), F.lit(") "), digits(2, 3), F.lit("-"), digits(3, 4)),
        join(digits(1, 3), F.lit("-"), digits(2, 3), F.lit("-"), digits(3, 4)),
        join(digits(1, 3), F.lit("."), digits(2, 3), F.lit("."), digits(3, 4)),
        join(F.lit("0"), digits(1, 3), F.lit(" "), digits(2, 4), F.lit(" "), digits(3, 3)),
        join(F.lit("0"), *(x for k in range(4) for x in (digits(k, 1), F.lit(" "), digits(9 + k, 1)))),
        join(F.lit("0"), digits(1, 3), F.lit("/"), digits(2, 7)),
        join(F.lit("0"), digits(1, 10)),
    ]
    plain = [
        join(pick("y", ["19", "20"]), digits(1, 2), F.lit("-"), digits(2, 2), F.lit("-"), digits(3, 2)),
        join(digits(1, 2), F.lit("."), digits(2, 2), F.lit("."), pick("y", ["19", "20"]), digits(3, 2)),
        join(pick("y", ["19", "20"]), digits(1, 2), F.lit("-"), pick("z", ["19", "20"]), digits(2, 2)),
        join(F.lit("978-"), digits(1, 1), F.lit("-"), digits(2, 2), F.lit("-"), digits(3, 6), F.lit("-"), digits(4, 1)),
        join(digits(1, 3), F.lit("-"), digits(2, 7)),
        join(digits(1, 4), F.lit("-"), digits(2, 4)),
        join(digits(1, 2), F.lit(" "), digits(2, 3), F.lit(" "), digits(3, 3)),
        join(digits(1, 3), F.lit("."), digits(2, 3), F.lit("."), digits(3, 3)),
        digits(1, 8),
        digits(1, 10),
    ]
    of = lambda salt, values: F.element_at(F.array(*values), (code(salt, len(values)) + 1).cast("int"))
    bank = join(digits(5, 9), digits(6, 9))
    check = F.lpad((98 - F.pmod(join(bank, F.lit("131400")).cast("decimal(38,0)"), F.lit(97)).cast("int")).cast("string"), 2, "0")
    spaced = lambda x: F.regexp_replace(x, "(.{4})(?=.)", "$1 ")
    iban = join(F.lit("DE"), check, bank)
    broken = join(pick("c", ["DE", "GB", "FR", "XK", "AB"]), digits(7, 2), F.upper(hexes("b", 16)))
    ssn = join(digits(1, 3), F.lit("-"), digits(2, 2), F.lit("-"), digits(3, 4))
    mac = F.regexp_replace(hexes("m", 12), "(..)(?=.)", "$1:")
    six = F.regexp_replace(hexes("s", 32), "(....)(?=.)", "$1:")
    times = join(digits(1, 1), *(x for k in range(2, 5) for x in (F.lit(":"), digits(k, 2))))

    shape, told = code("shape", 12), code("told", 10)
    cue, noise, other = (lambda k: pick("cue", cues[k])), pick("n", neutral), pick("x", others)
    # Per kind: text, what stands before, label.
    yes, no = F.lit(1.0), F.lit(0.0)
    loud = ~shy.isin(" at ", " AT ") | (dot != ".")
    cases = {
        "address": [
            (join(first, shy, second, dot, tld), F.when(told < 5, cue("address")).otherwise(noise), F.when((told < 5) | loud, yes).otherwise(no)),
            (join(pick("v", ["look", "was", "meet", "stay", "arrive", "out", "is"]), F.lit(" at "), second, F.lit("."), pick("w", ["the", "we", "com", "and", "there", "net"])), noise, no),
        ],
        "number": [
            (of("p", phones), cue("number"), yes),
            (F.when(told < 3, phones[0]).otherwise(of("p", phones[3:])), F.when(told < 3, noise).otherwise(other), F.when(told < 3, yes).otherwise(no)),
            (of("q", plain), F.when(told < 5, noise).otherwise(other), no),
            (of("q", [*plain, *phones[1:]]), noise, no),
        ],
        "account": [(F.when(told < 5, iban).otherwise(spaced(iban)), F.when(told < 6, cue("account")).otherwise(noise), yes), (F.when(told < 5, broken).otherwise(spaced(broken)), F.when(told < 5, noise).otherwise(other), no)],
        "identity": [(ssn, F.when(told < 6, cue("identity")).otherwise(noise), F.when(told < 6, yes).otherwise(no)), (F.translate(ssn, "-", " "), F.when(told < 5, noise).otherwise(other), no)],
        "host": [(F.when(told < 5, mac).otherwise(six), F.when(told < 5, cue("host")).otherwise(noise), yes), (times, F.when(told < 5, noise).otherwise(other), no)],
    }
    flat = [F.struct(F.lit(KINDS.index(k)).alias("kind"), t.alias("text"), b.alias("before"), y.alias("label")) for k, some in cases.items() for t, b, y in some]
    after = F.when(shape == 0, pick("e", [" km", " EUR", " pages", " people", "%"])).otherwise(pick("f", [".", " and so on", ", then", " ", "", " or later"]))
    drawn = rows.select("id", F.element_at(F.array(*flat), (code("case", len(flat)) + 1).cast("int")).alias("c"), after.alias("after"))
    label = F.when((F.col("c.kind") == KINDS.index("number")) & F.col("after").rlike(UNIT), 0.0).otherwise(F.col("c.label"))
    return drawn.select("id", "c.kind", "c.text", "c.before", "after", label.alias("label"))


def _written(node, values: Column) -> Column:
    """A regression tree as an expression of the features."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.get(values, F.lit(split.featureIndex())) <= F.lit(float(split.threshold())), _written(node.leftChild(), values)).otherwise(_written(node.rightChild(), values))


class Model:
    """Boosted trees and each kind's threshold."""

    def __init__(self, trees: GBTClassificationModel, thresholds: dict[int, float]):
        self.trees, self.thresholds = trees, thresholds

    def probability(self, values: Column) -> Column:
        margins = [F.lit(float(w)) * _written(t._java_obj.rootNode(), values) for w, t in zip(self.trees.treeWeights, self.trees.trees, strict=True)]
        return 1 / (1 + F.exp(-2 * reduce(lambda a, b: a + b, margins)))

    def least(self, kind: Column) -> Column:
        """The kind's threshold; 2 where no threshold is precise enough."""
        return F.get(F.array(*(F.lit(self.thresholds.get(i, 2.0)) for i in range(len(KINDS)))), kind)


def train(sample: DataFrame, rounds: int = 10, depth: int = 4, precision: float = 0.97) -> Model:
    """Trees from three quarters of a labelled sample, thresholds from the last one.

    A kind's threshold is the least probability from which on held-out candidates are personal data with this precision.
    """
    rows = sample.select("id", "kind", "label", features(F.col("kind"), F.col("text"), F.col("before"), F.col("after")).alias("values")).persist()
    held = F.pmod(F.xxhash64("id", F.lit("held")), F.lit(4)) == 0
    learner = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=1)
    trees = learner.fit(rows.where(~held).select("label", array_to_vector("values").alias("features")))
    model = Model(trees, {})
    scored = rows.where(held).select("kind", "label", F.round(model.probability(F.col("values")), 6).alias("p"))
    above = Window.partitionBy("kind").orderBy(F.desc("p"))
    counts = scored.groupBy("kind", "p").agg(F.sum("label").alias("right"), F.count(F.lit(1)).alias("all"))
    counts = counts.select("kind", "p", (F.sum("right").over(above) / F.sum("all").over(above)).alias("precision"))
    # The lowest of the probabilities from which on precision never falls below the one asked for.
    worst = counts.withColumn("worst", F.min("precision").over(above))
    for r in worst.where(F.col("worst") >= precision).groupBy("kind").agg(F.min("p").alias("p")).collect():
        model.thresholds[r.kind] = max(r.p - 1e-6, 0.5)
    rows.unpersist()
    return model


def _luhn(digits: Column) -> Column:
    """Whether the digits' sum, every second one from the right doubled, ends in 0."""

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(IP)
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))


SPANS = "array<struct<start:int,kind:int,end:int>>"


def _one_each(spans: Column) -> Column:
    """Of (start, end, p, kind), in order, one (start, kind, end) for each run that overlaps and holds no base span (p 2)."""
    reach = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    placed = F.transform(F.arrays_zip(spans.alias("s"), reach.alias("r")), lambda x, i: F.struct(x["s"].alias("s"), x["r"].alias("r"), i.alias("i")))

    def grouped(state: Column) -> Column:
        every = state["v"]
        head = F.transform(every, lambda x: (x["i"] == 0) | (x["s"]["start"] >= F.get(every, x["i"] - 1)["r"]))
        number = running(F.transform(head, lambda h: h.cast("int")))
        begin = running(F.transform(F.arrays_zip(head.alias("h"), spans.alias("s")), lambda x: F.when(x["h"], x["s"]["start"]).otherwise(-1)), F.greatest)
        best = running(F.transform(F.arrays_zip(number.alias("n"), spans.alias("s")), lambda x: F.struct(x["n"].alias("n"), x["s"]["p"].alias("p"), x["s"]["kind"].alias("kind"))), F.greatest)
        table = F.arrays_zip(reach.alias("end"), number.alias("n"), begin.alias("start"), best.alias("best"))
        last = F.filter(table, lambda x, i: F.coalesce(F.get(number, i + 1), F.lit(0)) != x["n"])
        return F.transform(F.filter(last, lambda x: x["best"]["p"] < 2), lambda x: F.struct(x["start"].alias("start"), x["best"]["kind"].alias("kind"), x["end"].alias("end")))

    return F.get(F.transform(F.array(F.struct(placed.alias("v"))), grouped), F.lit(0))


def find_personal_data(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every row.

    Returns a row for each row of docs: doc_id, text, base and more (arrays of start, kind, end; by kind, then start); kind is a
    place in KINDS, positions are code points, end exclusive. more holds what the trees add: none of it overlaps a base
    span or another one of more.

    Null text is empty and has no spans. Rows are read one by one and whole, so repeated rows, null ids and long texts need
    no care. An empty table gives an empty table. Other columns are ignored.
    """
    model = train(labelled_sample(docs.sparkSession)) if model is None else model
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    patterns = {**BASE, **GENERATORS}
    df = df.select("doc_id", "text", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in patterns.items()))
    tests = {k: F.transform(f"m_{k}", partial(_passes, k)) for k in BASE}
    fits = lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(*DIGITS)
    tests |= {k: F.transform(f"m_{k}", fits if k == "number" else lambda m: F.lit(True)) for k in GENERATORS}
    df = df.select("*", *(t.alias(f"ok_{k}") for k, t in tests.items()))
    # Only texts with a match that passes are split.
    some = {k: F.exists(f"ok_{k}", lambda x: x) for k in KINDS}
    df = df.select("*", *(F.when(some[k], F.split("text", p, -1)).alias(f"p_{k}") for k, p in patterns.items()))
    none = F.expr("array()").cast(SPANS)
    df = df.select("*", *(F.when(some[k], _spans(F.col(f"m_{k}"), F.col(f"p_{k}"), i)).otherwise(none).alias(f"s_{k}") for i, k in enumerate(KINDS)))
    base = F.concat(*(F.when(some[k], _where(F.col(f"s_{k}"), F.col(f"ok_{k}"))).otherwise(none) for k in BASE))

    def proposed(kind: str) -> Column:
        """Candidates with what stands around them: the text between two matches stands after one and before the other."""
        rows = F.arrays_zip(F.col(f"s_{kind}").alias("s"), F.col(f"m_{kind}").alias("m"), F.col(f"ok_{kind}").alias("ok"))
        pieces = F.col(f"p_{kind}")
        end = lambda c: F.right(F.coalesce(c, F.lit("")), F.lit(BEFORE))
        before = lambda i: end(F.concat(end(F.get(pieces, i - 1)), end(F.get(f"m_{kind}", i - 1)), end(F.get(pieces, i))))
        rows = F.transform(rows, lambda x, i: F.struct(x["s"].alias("s"), x["m"].alias("text"), x["ok"].alias("ok"), before(i).alias("before"), F.left(F.get(pieces, i + 1), F.lit(AFTER)).alias("after")))
        empty = F.expr("array()").cast("array<struct<s:struct<start:int,kind:int,end:int>,text:string,ok:boolean,before:string,after:string>>")
        return F.when(some[kind], F.filter(rows, lambda x: x["ok"])).otherwise(empty)

    df = df.select("doc_id", "text", base.alias("base"), F.concat(*map(proposed, GENERATORS)).alias("c"))
    seen = F.transform("c", lambda x: F.struct(x["s"].alias("s"), features(x["s"]["kind"], x["text"], x["before"], x["after"]).alias("f")))
    df = df.select("doc_id", "text", "base", seen.alias("c"))
    scored = F.transform("c", lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), model.probability(x["f"]).alias("p"), x["s"]["kind"].alias("kind")))
    df = df.select("doc_id", "text", "base", F.filter(scored, lambda x: x["p"] >= model.least(x["kind"])).alias("c"))
    fixed = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(2.0).alias("p"), s["kind"].alias("kind")))
    df = df.select("doc_id", "text", "base", F.when(F.size("c") > 0, F.sort_array(F.concat(fixed, "c"))).alias("u"))
    more = F.when(F.size("u") > 0, F.array_sort(_one_each(F.col("u")), lambda a, b: F.when((a["kind"] - b["kind"]) != 0, a["kind"] - b["kind"]).otherwise(a["start"] - b["start"]))).otherwise(none)
    return df.select("doc_id", "text", "base", more.alias("more"))


def redacted(found: DataFrame, mask: str = MASK) -> DataFrame:
    """(doc_id, text) of what find_personal_data returned, each span, or run of overlapping ones, replaced by the mask."""
    spans = found.select("doc_id", "text", F.sort_array(F.concat("base", "more")).alias("spans"))
    return spans.select("doc_id", masked("text", "spans", mask).alias("text"))


def written(*spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", *(F.transform(x, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))) for x in spans))


def op11_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(written("base"), 256).alias("base_sha256"), written("base", "more").alias("spans"))
