"""Chat formatting by prefix-target expansion: one example for each assistant turn, all earlier turns as context, that reply alone trainable.

A turn reads `### role: text</turn>` and a newline. Inside roles and texts the characters \\ < # : are written \\b \\l \\h \\c, so no text can
hold a control string, and unescape() gives the text back. An example has its formatted text and loss_start, loss_end: the code points under
the loss mask, which are the reply's own. What follows a conversation's last assistant turn comes as a row without a mask (target_turn null).

Defined results: null texts and roles are empty. Turns are in order of turn, then role, then text, so ties and repeated rows have one order.
Rows without a conversation id form a conversation of their own. A conversation without assistant turns has its rest row only.
No turns give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, MIDDLE, END = "### ", ": ", "</turn>\n"
ESCAPES = {"\\": "\\b", "<": "\\l", "#": "\\h", ":": "\\c"}
TARGET = "assistant"


def escape(text: Column) -> Column:
    for plain, written in ESCAPES.items():
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES.items()):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def expand(turns: DataFrame) -> DataFrame:
    """conv_id, target_turn, n_turns, formatted, loss_start, loss_end for turns (conv_id, turn, role, text)."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.concat(F.lit(START), escape(F.col("role")), F.lit(MIDDLE)).alias("head"), escape(F.col("text")).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.array_join(F.collect_list(F.concat("head", "body", F.lit(END))).over(order.rowsBetween(Window.unboundedPreceding, -1)), "")
    target = F.col("role") == TARGET
    place = F.row_number().over(order).cast("long")
    examples = rows.select("conv_id", "turn", target.alias("target"), "head", "body", place.alias("n_turns"), F.when(target, before).alias("context"))
    start = F.length("context") + F.length("head")
    examples = examples.where("target").select(
        "conv_id",
        F.col("turn").alias("target_turn"),
        "n_turns",
        F.concat("context", "head", "body", F.lit(END)).alias("formatted"),
        start.cast("long").alias("loss_start"),
        (start + F.length("body")).cast("long").alias("loss_end"),
    )
    later = F.coalesce(F.max(F.when(target, place_of := F.col("place"))).over(Window.partitionBy("conv_id")), F.lit(0))
    rest = rows.select("*", place.alias("place")).select("*", later.alias("last")).where(place_of > F.col("last"))
    rest = rest.groupBy("conv_id").agg(
        F.max("place").alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("head", "body", F.lit(END)).alias("s")))), lambda x: x.s), "").alias("formatted"),
    )
    none = F.lit(None).cast("long")
    rest = rest.select("conv_id", none.alias("target_turn"), "n_turns", "formatted", none.alias("loss_start"), none.alias("loss_end"))
    return examples.unionByName(rest)


def turns_of(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    parts = F.filter(F.split(formatted, END, -1), lambda x: x != "")
    role_end = lambda x: F.locate(MIDDLE, x)
    return F.transform(
        parts,
        lambda x: F.struct(
            unescape(F.substring(x, F.lit(len(START) + 1), role_end(x) - len(START) - 1)).alias("role"),
            unescape(F.substring(x, role_end(x) + len(MIDDLE), F.length(x))).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """One row for each conversation, from its examples alone: the last example and the rest give the turns, the masks the trained text."""
    masked = unescape(F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    trained = F.col("loss_start").isNotNull()
    per = examples.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max_by(F.when(trained, F.col("formatted")), F.when(trained, F.col("n_turns"))).alias("longest"),
        F.max(F.when(~trained, F.col("formatted"))).alias("rest"),
        F.array_sort(F.collect_list(F.when(trained, F.struct("n_turns", masked.alias("text"))))).alias("replies"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    turns = turns_of(F.concat(F.coalesce("longest", F.lit("")), F.coalesce("rest", F.lit(""))))
    loss = F.array_join("replies.text", "")
    return per.select(
        "conv_id",
        F.col("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
