"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each level looks only at rows that still share a group with another row.  What
passes from level to level is the set of keys that occur twice or more
(``common.KeySet``): bitmaps sized by their number, or a join where they are too
many.  A false member lets a row through that the next level drops; no row is
lost.  Full content is read and hashed for survivors only.

Defined cases: a null text counts as empty, and empty texts are equal to each
other.  Texts are compared after replacing every run of space and the bytes
0x09 to 0x0D by one space.  Rows that repeat a doc_id count as rows of their
group: ``exact_dedup`` marks each row whose doc_id is the group's smallest as
kept, ``distinct_documents`` leaves one row of each group.  Null ids are never
the smallest unless the group has no other.  Columns of any name go along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters of the normalised text that the prefix hash covers.
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """``text`` with each run of white space as one space; null is empty."""
    flat = F.coalesce(text, F.lit(""))
    for code in (0x09, 0x0A, 0x0B, 0x0C, 0x0D):
        flat = F.replace(flat, F.lit(chr(code)), F.lit(" "))
    return F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " {2,}", " ")).otherwise(flat)


def _twice(keys: DataFrame, key: str) -> common.KeySet:
    """The keys of two rows or more."""
    return common.KeySet(keys.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), key)


def refine(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, inside): each row as a struct, and whether another row may have its length and prefix."""
    text = normalised(F.col(f"`{text_col}`"))
    keys = common.durable(docs.select(F.length(text).cast("long").alias("length"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("prefix")))
    same_length = _twice(keys, "length").marked(keys, F.col("length")).where("inside")
    same_prefix = _twice(same_length.select(F.xxhash64("row.length", "row.prefix").alias("key")), "key")
    return same_prefix.marked(docs, F.xxhash64(F.length(text).cast("long"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS))))


def full_hash(text: Column) -> Column:
    """SHA-256 of the normalised text, binary."""
    return F.unhex(F.sha2(normalised(text), 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, full_hash.

    full_hash is null for a text whose length and prefix no other row has, unless
    ``digests`` asks for all.  An empty table gives an empty result.
    """
    found = refine(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")))
    hashed = full_hash(F.col("row.text"))
    found = found.select(F.col("row.id").alias("id"), "inside", (hashed if digests else F.when(F.col("inside"), hashed)).alias("full_hash"))
    maybe = found.where("inside")
    groups = common.durable(maybe.groupBy("full_hash").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
    alone = found.where("NOT inside").select("id", "full_hash", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    grouped = common.salted_left_join(maybe.select("id", "full_hash"), groups, "full_hash")
    grouped = grouped.select("id", "full_hash", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    return alone.unionByName(grouped).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "full_hash")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, the one with the smallest id, with all its columns.

    Of rows that repeat that id the one with the least hash of all columns stays.
    Only rows that may have a copy are shuffled, after a first choice within each task.
    """
    found = refine(docs, text_col)
    own = F.col(f"row.`{id_col}`")
    order = F.struct(own.isNull().alias("a"), own.alias("b"), F.xxhash64("row").alias("c"))
    chosen = found.where("inside").groupBy(full_hash(F.col(f"row.`{text_col}`")).alias("full_hash")).agg(F.min_by("row", order).alias("row"))
    return found.where("NOT inside").select("row.*").unionAll(chosen.select("row.*"))
