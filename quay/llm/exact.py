"""Exact deduplication with skew-safe combining.

Copies are combined in three steps, each of which groups by the digest and the whole text: within a task before anything
is shuffled (Spark's partial aggregate), then by (digest, salt), then the salts' winners by digest. A text held by
a third of all rows so costs each salt task a few rows. Grouping by content also tells whether any digest has two
texts; for such digests alone the membership join compares texts, for all others the digest stands for the text. Digests of
the largest groups, of which there can only be so many, are broadcast to that join, so their rows are not shuffled to one task.

Defined cases: null text counts as empty; the row with the largest doc_id stays, and of rows with that same doc_id and text
all are reported as kept since nothing tells them apart; a null doc_id is smaller than all others; an empty table gives
no rows; other columns are ignored here and carried by ``kept_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quay.llm import shared


#: A group that holds at least this part of all repeated rows is large; so there are at most HOT such groups, of some 100 bytes each.
HOT = 2000


def prepared(docs: DataFrame, normal: Column | None = None) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string") if normal is None else normal, F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", F.sha2(F.col("text"), 256))


def groups(rows: DataFrame, salts: int = 16) -> DataFrame:
    """One row per distinct text: digest, text, keep_id, group_size."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")
    salted = rows.groupBy("digest", salt, "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, *, salts: int = 16, normal: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. ``normal``: the text to compare, if not ``text``."""
    rows = prepared(docs, normal)
    contents = groups(rows, salts).groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    repeated = shared.stored(contents.where("contents > 1 or group_size > 1"), "copies")
    single = repeated.where("contents = 1").drop("contents")
    clashing = repeated.where("contents > 1").select("digest")
    plain = rows.select("doc_id", "digest")
    parts = []
    if clashing.limit(1).count():  # two texts with one digest
        texts = groups(rows.join(clashing, "digest", "left_semi"), salts)
        parts = [rows.join(clashing, "digest", "left_semi").join(texts, ["digest", "text"]).select("digest", "doc_id", "keep_id", "group_size")]
        plain = plain.join(clashing, "digest", "left_anti")
    rows_repeated = repeated.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    large = F.col("group_size") * HOT >= rows_repeated
    hot = single.where(large).select("digest", F.struct("keep_id", "group_size").alias("hot"))
    # rows of large groups have their answer before the shuffle, in which they are dealt by their own ids
    marked = plain.join(F.broadcast(hot), "digest", "left").withColumn("at", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string"))))
    cold = single.where(~large).select(F.col("digest").alias("at"), F.struct("keep_id", "group_size").alias("cold"))
    found = F.coalesce("hot", "cold")
    out = marked.join(cold, "at", "left").select("digest", "doc_id", F.coalesce(found["keep_id"], "doc_id").alias("keep_id"), F.coalesce(found["group_size"], F.lit(1)).alias("group_size"))
    for x in parts:
        out = out.unionByName(x)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def kept_documents(docs: DataFrame, salts: int = 16) -> DataFrame:
    """The documents that stay, with all their columns."""
    mine, digest = shared.unused(docs, "id"), shared.unused(docs, "digest")
    dropped = exact_dedup(docs, salts=salts).where("not kept").select(F.col("doc_id").alias(mine), F.col("text_sha256").alias(digest)).distinct()
    own = F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)
    return docs.join(dropped, docs["doc_id"].eqNullSafe(F.col(mine)) & (own == F.col(digest)), "left_anti")
