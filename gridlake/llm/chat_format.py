"""Relational chat formatting with Spark expressions only.

A conversation's turns are collected and sorted (by turn, then role, then text), adjacent turns of one role are
merged into a block, and the blocks are joined:

    <s>[INST]role[/INST]text[TURN]text ... </s>

The five control strings mark blocks, roles and turns.  Inside roles and texts they are escaped by a backslash
after their first character; one that already has backslashes there gets one more, so the change is reversible.
``loss`` holds the place (code points from 1) and length of every assistant text.

Defined cases: null role or text counts as empty; a null turn sorts first; a null conv_id is a conversation;
repeated rows are turns of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END, ROLE, TEXT, TURN = "<s>", "</s>", "[INST]", "[/INST]", "[TURN]"
_TAIL = r"(/?s>|/?INST\]|TURN\])"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + _TAIL, r"$1$2\\$3")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + _TAIL, "$1$2$3")


def _size(c: Column) -> Column:
    return F.length(c).cast("long")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (array of struct start, length)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    # places (from 1) of the turns that begin a block
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at("turns", i)["role"]
                                                                  != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    placed = sorted_.withColumn("begins", begins)
    stop = lambda k: F.coalesce(F.get("begins", k + 1), n + 1)
    merged = F.transform("begins", lambda i, k: F.struct(
        F.element_at("turns", i)["role"].alias("role"),
        F.transform(F.slice("turns", i, stop(k) - i), lambda t: escaped(t["text"])).alias("texts")))
    blocks = placed.select("conv_id", merged.alias("blocks"))
    head = lambda b: F.concat(F.lit(BEGIN + ROLE), escaped(b["role"]), F.lit(TEXT))
    whole = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], TURN), F.lit(END))), "")

    spans_type = "array<struct<start:bigint,length:bigint>>"
    state = F.struct(F.lit(1).cast("long").alias("at"), F.expr(f"cast(array() as {spans_type})").alias("spans"))

    def add_text(trained: Column):
        def add(s: Column, t: Column) -> Column:
            own = F.array(F.struct(s["at"].alias("start"), _size(t).alias("length")))
            return F.struct((s["at"] + _size(t) + len(TURN)).alias("at"),
                            F.when(trained, F.concat(s["spans"], own)).otherwise(s["spans"]).alias("spans"))
        return add

    def add_block(s: Column, b: Column) -> Column:
        inside = F.struct((s["at"] + _size(head(b))).alias("at"), s["spans"].alias("spans"))
        after = F.aggregate(b["texts"], inside, add_text(b["role"] == "assistant"))
        return F.struct((after["at"] - len(TURN) + len(END)).alias("at"), after["spans"].alias("spans"))

    return blocks.select("conv_id", whole.alias("formatted"), F.aggregate("blocks", state, add_block)["spans"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of struct role, text) and loss_text, from conv_id, formatted and loss alone."""
    blocks = F.filter(F.split("formatted", END), lambda b: b != "")
    head = lambda b: F.substring_index(b, TEXT, 1)
    role = lambda b: unescaped(F.substr(head(b), F.lit(len(BEGIN + ROLE) + 1)))
    texts = lambda b: F.split(F.substr(b, F.length(head(b)) + len(TEXT) + 1), r"\[TURN\]")
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(texts(b), lambda t: F.struct(
        role(b).alias("role"), unescaped(t).alias("text")))))
    trained = F.array_join(F.transform("loss", lambda s: unescaped(
        F.substr(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int")))), "")
    return formatted.select("conv_id", turns.alias("turns"), trained.alias("loss_text"), "formatted")
