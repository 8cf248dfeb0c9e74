"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it as context, and only its text trainable. A last
example of each conversation holds all its turns with nothing trainable, so turns after the last reply aren't lost.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn. In roles and texts each control string gets one more
backslash after its first character than it has (``<|im_end|>`` becomes ``<\\|im_end|>``), which is undone on reading.

Edge cases: null text or role is the empty string. Rows of one conversation are ordered by turn (nulls first), then role,
then text, so repeated rows and ties give a defined order. Rows without conv_id form one conversation. An empty table gives
an empty result. Other columns of the input are ignored. A conversation is one row here, as each example holds all of its
context anyway; examples are cut from the one rendered string, so memory follows the conversation, not its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What follows the first character of a control string; more than the template's own are escaped.
_REST = r"\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|/?SYS>>"
TRAINABLE_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_REST})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_REST})", "$1$2$3")


def format_chat(conversations: DataFrame) -> DataFrame:
    """(conv_id, example long, target_index int, formatted, loss_start, loss_chars): one row per example.

    target_index is the target's 0-based place among the conversation's turns, null for the closing example. The loss mask
    is the code points from loss_start (0-based), loss_chars of them, in formatted.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select("conv_id", F.struct("turn", text("role").alias("role"), text("text").alias("text")).alias("t"))
    # a turn's rendering, and the places of its text and of its end within it
    rendered = F.transform(
        F.array_sort(F.collect_list("t")),
        lambda t: F.struct(
            (t["role"] == TRAINABLE_ROLE).alias("train"),
            F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )
    whole = turns.groupBy("conv_id").agg(rendered.alias("r"))
    sized = whole.withColumn("len", F.transform("r", lambda t: F.length(t["head"]).cast("bigint") + F.length(t["body"]) + len(END)))
    zero = F.array().cast("array<bigint>")
    first = F.struct(F.lit(0).cast("bigint").alias("sum"), zero.alias("starts"))
    starts = F.aggregate("len", first, lambda s, n: F.struct((s["sum"] + n).alias("sum"), F.array_append(s["starts"], s["sum"]).alias("starts")), lambda s: s["starts"])
    spans = F.filter(
        F.transform(
            F.arrays_zip("r", "len", "start"),
            lambda z, i: F.struct(
                z["r"]["train"].alias("train"),
                i.alias("target_index"),
                (z["start"] + z["len"]).alias("end"),
                (z["start"] + F.length(z["r"]["head"])).alias("loss_start"),
                F.length(z["r"]["body"]).cast("bigint").alias("loss_chars"),
            ),
        ),
        lambda s: s["train"],
    )
    closing = F.struct(
        F.lit(False).alias("train"), F.lit(None).cast("int").alias("target_index"), F.length("full").cast("bigint").alias("end"),
        F.lit(None).cast("bigint").alias("loss_start"), F.lit(0).cast("bigint").alias("loss_chars"),
    )
    text_of = F.array_join(F.transform("r", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    whole = sized.withColumn("start", starts).select("conv_id", text_of.alias("full"), spans.alias("spans"))
    whole = whole.withColumn("spans", F.concat("spans", F.array(closing)))
    examples = whole.select("conv_id", "full", F.posexplode("spans").alias("example", "s"))
    cut = F.substring(F.col("full"), F.lit(1), F.col("s.end").cast("int"))
    return examples.select(
        "conv_id", F.col("example").cast("bigint").alias("example"), "s.target_index", cut.alias("formatted"), "s.loss_start", "s.loss_chars"
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>"), lambda p: p.startswith(START))
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, F.lit(len(START) + 1), F.length(p)), SEP, 1)).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, SEP, 1)) + len(SEP) + 1, F.length(p))).alias("text"),
        ),
    )


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns from the closing one, losses from the masks in order."""
    loss = unescape(F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")))
    turns = F.when(F.col("target_index").isNull(), read_turns(F.col("formatted")))
    rows = examples.select("conv_id", "example", F.when(F.col("target_index").isNotNull(), loss).alias("loss"), turns.alias("turns"), F.length("formatted").cast("bigint").alias("n"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    ordered = F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss"))))
    per = rows.groupBy("conv_id").agg(
        F.max(F.size("turns")).cast("bigint").alias("n_turns"),
        F.max(F.sha2(told, 256)).alias("turns_sha256"),
        F.array_join(F.transform(ordered, lambda x: x["loss"]), "").alias("loss"),
        F.sum("n").alias("formatted_chars"),
        (F.count("*") - 1).alias("n_examples"),
    )
    return per.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
