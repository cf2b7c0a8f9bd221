"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns become `<|turn|>role<|text|>text<|end|>`. Prefix sums of turn tokens cut a conversation into turn-aligned
windows; each keeps the leading system turn, repeats a limited history, and masks everything but the assistant
texts that are new in it, so each assistant text is a target exactly once. Control strings inside roles and texts
get a tilde after their first character, which is taken out again when reading back.

A turn belongs as new to the window of the stretch of `stride` prefix tokens in which it ends, so a window holds at
most stride tokens beside its first turn, the system turn and `history` tokens of repeated turns. A turn is never cut.

Defined cases: a null text or role counts as empty; turns with equal numbers are ordered by role and text; repeated
rows are turns of their own; rows with a null conv_id are one conversation; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# What follows the first character of control strings, of this template and of common others.
_AFTER = r"(\||/?s>|/?INST\]|</?SYS>>)"
STRIDE, HISTORY = 768, 256


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([<\[])(~*)" + _AFTER, "$1$2~$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(~*)~" + _AFTER, "$1$2$3")


def windows(turns: DataFrame, stride: int = STRIDE, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, text, n_repeated, loss): formatted windows of turns (conv_id, turn, role, text).

    The first n_repeated turns of a window repeat earlier ones; loss has the spans of text (start, end; code
    points, end exclusive) that are targets. history is at most stride."""
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("n", F.row_number().over(by_turn)).withColumn("system", (F.col("n") == 1) & (F.col("role") == "system"))
    t = t.withColumn("tokens", F.when(F.col("system"), 0).otherwise(F.size(F.split("text", r"\s+")) + 4).cast("long"))
    in_order = Window.partitionBy("conv_id").orderBy("n")
    t = t.withColumn("till", F.sum("tokens").over(in_order)).withColumn("since", F.col("till") - F.col("tokens"))
    t = t.withColumn("window", F.dense_rank().over(Window.partitionBy("conv_id").orderBy(F.floor(F.greatest(F.col("till") - 1, F.lit(0)) / stride))))
    t = t.select("conv_id", "n", "system", "since", "window", F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT)).alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("target"))
    first = t.groupBy(F.col("conv_id").alias("of"), F.col("window").alias("at")).agg(F.min("since").alias("first"))
    # a turn can be history of the three windows after its own at most, as three windows span over one stride
    spread = t.where(~F.col("system")).withColumn("to", F.explode(F.array(*(F.col("window") + k for k in range(4)))))
    shown = spread.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("to") == F.col("at"))).where((F.col("at") == F.col("window")) | (F.col("first") - F.col("since") <= history))
    lead = t.where("system").join(first, F.col("conv_id").eqNullSafe(F.col("of")))
    repeated = (F.col("at") != F.col("window")).alias("repeated")
    shown = shown.select("conv_id", "at", "n", "head", "body", "target", repeated).union(lead.select("conv_id", "at", "n", "head", "body", "target", repeated))
    item = F.struct("n", "repeated", F.concat("head", "body", F.lit(END)).alias("text"), F.length("head").alias("head"), F.length("body").alias("body"), F.col("target") & ~F.col("repeated"))
    rows = shown.groupBy("conv_id", F.col("at").alias("window")).agg(F.array_sort(F.collect_list(item.cast("struct<n:int,repeated:boolean,text:string,head:int,body:int,target:boolean>"))).alias("turns"))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("loss")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["text"])).alias("at"),
            F.when(x["target"], F.concat(acc["loss"], F.array(F.struct((acc["at"] + x["head"]).alias("start"), (acc["at"] + x["head"] + x["body"]).alias("end"))))).otherwise(acc["loss"]).alias("loss"),
        ),
    )
    return rows.select("conv_id", "window", F.array_join(F.transform("turns", lambda x: x["text"]), "").alias("text"), F.size(F.filter("turns", lambda x: x["repeated"])).alias("n_repeated"), spans["loss"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted_chars) parsed from formatted windows: turns (role, text) in order, each once."""
    cut = F.filter(F.split("text", r"<\|end\|>"), lambda x: x != "")
    turn = F.transform(cut, lambda x: F.struct(unescaped(F.substring_index(F.substring(x, len(TURN) + 1, 1 << 30), TEXT, 1)).alias("role"), unescaped(F.substring_index(x, TEXT, -1)).alias("text")))
    parsed = formatted.select("conv_id", "window", F.slice(turn, F.col("n_repeated") + 1, F.greatest(F.size(turn) - F.col("n_repeated"), F.lit(0))).alias("turns"), F.transform("loss", lambda x: unescaped(F.substring("text", (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))).alias("loss"), F.length("text").cast("long").alias("chars"))
    in_order = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("window", c))), lambda x: x[c]))
    return parsed.groupBy("conv_id").agg(in_order("turns").alias("turns"), in_order("loss").alias("loss_texts"), F.sum("chars").alias("formatted_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's figures of each conversation, read back from formatted windows."""
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
