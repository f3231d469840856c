"""Chat formatting with collapse of cumulative snapshots (operator 5), DataFrame operations only.

Logs often hold a conversation once per turn, each time one turn longer.  Every
turn gets a rolling hash of the turns up to it; a conversation whose last hash
is a hash inside a longer one is a prefix of it and goes (anti-join), and of equal
ones the smallest id stays.  What is left is rendered.

Hashes, not texts, are sorted and joined; equal conversations are folded before
the join, so a conversation logged a million times is one row there.  Prefixes
are compared by 128 bits over position, role and text.

Turns are in the order of `turn`, then role and text (null first).  A null role
or text is rendered as empty but differs from an empty one when compared.  Rows
without a conversation id form a conversation of their own per row, with a null
id.  Repeated turns are turns.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specforge.llm.common import stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The four columns, and `own`, which tells rows without an id apart."""
    own = F.when(F.col(conv).isNull(), F.struct(F.xxhash64(turn, role, text), F.hash(text, role, turn)))
    return df.select(F.col(conv).alias("conv_id"), own.alias("own"), F.col(turn).alias("turn"),
                     F.col(role).alias("role"), F.col(text).alias("text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, own, n (turns up to this one), h1 and h2 of them, turns (of the whole conversation)."""
    null = F.concat(F.col("role").isNull().cast("string"), F.col("text").isNull().cast("string"))
    narrow = turns.select("conv_id", "own", "turn", "role", F.struct(
        F.xxhash64("role", "text").alias("a"), F.hash("text", "role").alias("b"), null.alias("null")).alias("of"))

    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumns({f"h{k}": F.xxhash64(F.lit(k), F.col("n"), F.col("of")) for k in (1, 2)})

    conv = Window.partitionBy("conv_id")
    # Rows that tie are equal but for hash collisions, so any order gives the same hashes.
    order = conv.orderBy("turn", "role", "of")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = hashed(narrow.where("conv_id is not null").withColumn("n", F.row_number().over(order))
                   .withColumn("turns", F.count("*").over(conv)))
    alone = hashed(narrow.where("conv_id is null").withColumn("n", F.lit(1)))
    return named.select("conv_id", "own", "n", "turns", F.bit_xor("h1").over(upto).alias("h1"),
                        F.bit_xor("h2").over(upto).alias("h2")).unionAll(
        alone.select("conv_id", "own", "n", F.lit(1).cast("bigint").alias("turns"), "h1", "h2"))


def maximal(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """conv_id, own, n_turns, n_copies of the conversations that are no prefix of another."""
    every = stored(prefixes(_plain(df, conv, turn, role, text)))
    key = ["n", "h1", "h2"]
    whole = (every.where("n = turns").groupBy(*key)
             .agg(F.min(F.struct(F.col("conv_id").isNull().alias("no"), "conv_id", "own")).alias("first"),
                  F.count("*").alias("n_copies")))
    inner = every.where("n < turns").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select(
        "first.conv_id", "first.own", F.col("n").cast("bigint").alias("n_turns"), "n_copies")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")),
                    F.lit(CLOSE + "\n"))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """conv_id, n_turns, n_copies, chat: one rendered text per maximal conversation.

    Only turns of kept conversations are gathered; a chat is one text, so its turns
    meet in one row.
    """
    kept = stored(maximal(df, conv, turn, role, text))
    turns = _plain(df, conv, turn, role, text)
    same = turns["conv_id"].eqNullSafe(kept["conv_id"]) & turns["own"].eqNullSafe(kept["own"])
    joined = turns.join(kept, same).select(
        kept["conv_id"], kept["own"], "n_turns", "n_copies", kept["conv_id"].isNull().alias("alone"),
        F.struct("turn", "role", "text").alias("item"))
    # Equal rows without an id are one conversation, whatever their number.
    named = (joined.where("not alone").groupBy("conv_id", "own", "n_turns", "n_copies")
             .agg(F.sort_array(F.collect_list("item")).alias("items")))
    alone = (joined.where("alone").groupBy("conv_id", "own", "n_turns", "n_copies")
             .agg(F.array(F.min("item")).alias("items")))
    chat = F.array_join(F.transform("items", lambda i: rendered(i.role, i.text)), "")
    return named.unionAll(alone).select("conv_id", "n_turns", "n_copies", chat.alias("chat"))
