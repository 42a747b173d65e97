"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>"


def escape(text: Column) -> Column:
    """A backslash goes into every control string, after those already there; unescape takes it out."""
    text = F.regexp_replace(text, r"<(\\*)(\||/?s>)", r"<\\$1$2")
    return F.regexp_replace(text, r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<\\(\\*)(\||/?s>)", r"<$1$2")
    return F.regexp_replace(text, r"\[\\(\\*)(/?INST\])", r"[$1$2")


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv, formatted, mask) of every conversation.

    Turn structs are collected and sorted by turn, then role and text (nulls first). Adjacent
    turns of one role merge into a block: <|turn|>role<|text|>text<|more|>text<|end|>. Control
    strings inside roles and texts get a backslash, so marks are never forged and reading back
    (read_turns) is exact. mask array<struct<chars, bytes, loss>> are run lengths over formatted, in code points and in
    UTF-8 bytes; loss covers the texts of role ``learn``, without marks.

    Work per conversation is linear in its turns; a conversation is one row, so it must fit
    in a task, as a training example must. Null text and null role are empty; a null
    conversation id is one conversation; repeated rows are turns of their own; other columns are
    ignored. An empty table gives no rows.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = rows.groupBy(F.col(conv_col).alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    got = got.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text"))))
    # Blocks begin where the role changes; each block aggregates the texts up to the next one.
    begins = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.get("turns", i - 2)["role"]))
    got = got.withColumn("begins", begins)
    block = lambda b, k: F.struct(
        F.element_at("turns", b)["role"].alias("role"),
        F.transform(F.slice("turns", b, F.coalesce(F.get("begins", k + 1), F.size("turns") + 1) - b), lambda t: t["text"]).alias("texts"),
    )
    got = got.select("conv", F.transform("begins", block).alias("blocks"))
    join = lambda b: F.concat(F.lit(TURN), escape(b["role"]), F.lit(TEXT), F.array_join(b["texts"], MORE), F.lit(END))
    run = lambda text, loss: F.struct(F.length(text).cast("long").alias("chars"), F.octet_length(text).cast("long").alias("bytes"), loss.alias("loss"))
    mark = lambda text: run(text, F.lit(False))
    runs = lambda b: F.concat(
        F.array(mark(F.concat(F.lit(TURN), escape(b["role"]), F.lit(TEXT)))),
        F.flatten(F.transform(b["texts"], lambda t, i: F.array(mark(F.when(i > 0, MORE).otherwise("")), run(t, b["role"] == learn)))),
        F.array(mark(F.lit(END))),
    )
    return got.select(F.col("conv").alias(conv_col), F.array_join(F.transform("blocks", join), "").alias("formatted"), F.flatten(F.transform("blocks", runs)).alias("mask"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that format_chats got, in order."""
    blocks = F.filter(F.split(formatted, r"<\|turn\|>"), lambda b: b != "")

    def turns(b: Column) -> Column:
        cut = F.split(F.regexp_replace(b, r"<\|end\|>$", ""), r"<\|text\|>")
        return F.transform(F.split(cut[1], r"<\|more\|>"), lambda t: F.struct(unescape(cut[0]).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, mask: Column) -> Column:
    """The text under the loss mask, unescaped run by run, in order, nothing between. Runs are cut from the bytes, each at its own place."""
    start = F.struct(F.lit(1).cast("long").alias("at"), F.expr("cast(array() as array<struct<at: long, bytes: long>>)").alias("runs"))

    def step(s, r):
        here = F.struct(s["at"].alias("at"), r["bytes"].alias("bytes"))
        return F.struct((s["at"] + r["bytes"]).alias("at"), F.when(r["loss"], F.array_append(s["runs"], here)).otherwise(s["runs"]).alias("runs"))

    raw = formatted.cast("binary")
    cut = lambda r: F.decode(F.substring(raw, r["at"].cast("int"), r["bytes"].cast("int")), "UTF-8")
    return F.array_join(F.transform(F.aggregate(mask, start, step)["runs"], lambda r: unescape(cut(r))), "")
