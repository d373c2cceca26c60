"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant the dialogue is rendered once with that speaker as the assistant and all others as named users;
system turns stay system turns. The mask lists the code point ranges that the assistant wrote, the only ones
a model learns from.

A dialogue may hold any share of all rows, in any number of turns or in many rows of one turn. So no task gathers one:
the turns are sorted over all partitions, numbered by partition and place, and dealt by number into parts of PART
turns of their dialogue. Parts are rendered for themselves and then take their starts from the lengths before them: the
texts of all parts, joined, are the whole dialogue, and masks count from its first character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumflow.llm.common import Scratch, join_small, running

#: Turns in a part of a dialogue.
PART = 1024
SYSTEM = "system"
END = "<|end|>\n"
#: Bits of monotonically_increasing_id that count within a partition.
PLACE_BITS = 33


def _head(role: Column, speaker: Column) -> Column:
    """The head of a turn; speaker: who is the assistant, or null for nobody."""
    name = F.when(role == SYSTEM, "system").when(role == speaker, "assistant").otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit("<|"), name, F.lit("|>\n"))


def _numbered(df: DataFrame, scratch: Scratch, part: int) -> DataFrame:
    """The turns with the number of their part within the dialogue, by turn, role and text; stored twice in between."""
    keys = ["conv", "turn", "role", "text"]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The running number lets equal rows go to several partitions.
    placed = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(n, *keys, "_tie").sortWithinPartitions(*keys).drop("_tie")
    placed = scratch.store(placed.withColumn("_at", F.monotonically_increasing_id()), "turns")
    place = F.expr(f"_at & {(1 << PLACE_BITS) - 1}L")
    owner = F.shiftright("_at", PLACE_BITS)
    counts = placed.groupBy(owner.alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    # One row for each partition.
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_p", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_p", owner).join(F.broadcast(before), "_p").withColumn("_n", F.col("_before") + place)
    first = scratch.store(numbered.groupBy("conv").agg(F.min("_n").alias("_first")), "first")
    return join_small(numbered, first, ["conv"], "inner", 64).select(*keys, F.floor((F.col("_n") - F.col("_first")) / part).cast("long").alias("part"))


def _starts(df: DataFrame, speakers: DataFrame) -> DataFrame:
    """conv, speaker, part, start: code points of the parts before, for the later parts of long dialogues.

    The text of a part is as long for all speakers, but that their own turns have another head.
    """
    long = df.where("part > 0").select("conv").distinct()
    sizes = df.join(long, "conv", "left_semi").groupBy("conv", "part", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    of_other = lambda role: F.length(_head(F.col(role), F.lit(None).cast("string")))
    whole = sizes.groupBy("conv", "part").agg(F.sum(F.col("chars") + F.col("n") * (of_other("role") + len(END))).alias("length"))
    own = sizes.select("conv", "part", F.col("role").alias("speaker"), "n")
    sides = whole.join(speakers, "conv").join(own, ["conv", "part", "speaker"], "left")
    length = F.col("length") + F.coalesce("n", F.lit(0)) * (F.length(_head(F.col("speaker"), F.col("speaker"))) - of_other("speaker"))
    earlier = Window.partitionBy("conv", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sides.select("conv", "speaker", "part", F.sum(length).over(earlier).alias("start")).where("part > 0")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART) -> DataFrame:
    """Every dialogue from every participant's side, in parts of `part` turns.

    Returns conv_id, speaker, part (from 0), start (code points of the parts before), n_turns, n_own (turns of the speaker),
    text and mask (start:end of each own turn with its end mark, in code points of the whole dialogue, comma-joined). The texts
    of all parts in order make up the dialogue; one of up to `part` turns is one row.

    Turns go by turn, role and text; repeated rows are repeated turns. A null turn comes first. A null role is the role
    "unknown", a null text is empty. Null conversation ids are one dialogue. Dialogues with system turns only have no
    participant and no row. An empty table gives an empty table. Other columns are ignored.
    """
    scratch = Scratch(turns.sparkSession)
    df = turns.select(
        F.struct(F.col(conv_col).alias("conv_id")).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    df = _numbered(df, scratch, part)
    speakers = scratch.store(df.where(F.col("role") != SYSTEM).select("conv", F.col("role").alias("speaker")).distinct(), "speakers")
    starts = scratch.store(_starts(df, speakers), "starts")
    parts = df.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    sides = join_small(parts.join(speakers, "conv"), starts, ["conv", "speaker", "part"], "left", 128)
    speaker = F.col("speaker")
    sides = sides.withColumn("start", F.coalesce("start", F.lit(0).cast("long")))
    sides = sides.withColumn("heads", F.transform("turns", lambda t: _head(t["role"], speaker)))
    sides = sides.withColumn("bodies", F.transform("turns", lambda t: F.concat(t["text"], F.lit(END))))
    sides = sides.withColumn("own", F.transform("turns", lambda t: t["role"] == speaker))
    sides = sides.withColumn("ends", running(F.zip_with("heads", "bodies", lambda h, b: (F.length(h) + F.length(b)).cast("long"))))
    spans = F.filter(F.arrays_zip("bodies", "own", "ends"), lambda x: x["own"])

    def written(x: Column) -> Column:
        end = F.col("start") + x["ends"]
        return F.concat_ws(":", (end - F.length(x["bodies"])).cast("string"), end.cast("string"))

    return sides.select(
        "conv.conv_id",
        "speaker",
        "part",
        "start",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("own", lambda x: x)).cast("long").alias("n_own"),
        F.concat_ws("", F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b))).alias("text"),
        F.concat_ws(",", F.transform(spans, written)).alias("mask"),
    )


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
