"""Chat formatting with the collapse of cumulative snapshots.

Logs often hold a conversation again and again, each time with a few more turns. A rolling hash over the turns gives every conversation the hashes of all
its prefixes; a conversation whose whole hash is a proper prefix of another goes (an anti join), of equal ones the least
conv_id stays, and what is left is rendered.

Defined cases: null role or text counts as empty; turns are ordered by turn, then role, then text, a null turn first; rows that
repeat exactly are one turn; a null conv_id is an id like any other and the least of all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def threads(turns: DataFrame) -> DataFrame:
    """One row per conversation: its turns in order and the rolling hashes of its prefixes."""
    clean = turns.select(F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    rows = clean.groupBy("conv_id").agg(said.alias("turns"))
    step = lambda last, t: F.sha2(F.concat(last, F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]), 256)
    rolled = F.aggregate(
        "turns",
        F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all")),
        lambda acc, t: F.struct(step(acc["last"], t).alias("last"), F.concat(acc["all"], F.array(step(acc["last"], t))).alias("all")),
        lambda acc: acc["all"],
    )
    return rows.withColumn("hashes", rolled).withColumn("whole", F.element_at("hashes", -1))


def maximal(turns: DataFrame) -> DataFrame:
    """The conversations that no other continues: conv_id, turns, copies (how many equal ones there are)."""
    all_threads = threads(turns)
    # the hash alone is grouped and joined: one row per distinct conversation, however often it was logged
    best = all_threads.groupBy("whole").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")).alias("least"), F.count(F.lit(1)).alias("copies"))
    prefixes = all_threads.select(F.explode(F.slice("hashes", F.lit(1), F.size("hashes") - 1)).alias("whole")).distinct()
    kept = best.join(prefixes, "whole", "left_anti").select(F.col("least.conv_id").alias("_id"), "copies")
    return all_threads.join(kept, F.col("conv_id").eqNullSafe(F.col("_id"))).select("conv_id", "turns", "copies")


def render(conversations: DataFrame, *, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """conv_id, n_turns, copies and the text of each conversation in a template of marked turns."""
    turn = lambda t: F.concat(F.lit(begin), t["role"], F.lit("\n"), t["text"], F.lit(end + "\n"))
    return conversations.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "copies", F.array_join(F.transform("turns", turn), "").alias("rendered"))


def chat_format(turns: DataFrame) -> DataFrame:
    return render(maximal(turns))
