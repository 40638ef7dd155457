"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Only DataFrame functions are used. Each level keeps the groups that still hold two rows or more:

1. rows per length (partial aggregation, so a hot length shrinks before the shuffle);
2. rows per (length, hash of the first bytes), among lengths that survive;
3. the full SHA-256, computed only for rows whose (length, prefix hash) survives.

A row leaves at the first level where it is alone. Survivors of a level reach the next one as a key
sketch (sketch.py), of fixed size and broadcast whatever the data's size, so that texts stay where they
are: a row that passes a sketch by chance leaves at the level after it. Only row numbers and hashes are
shuffled. Group sizes are sums that are partially aggregated, and nothing is collected.

Decisions are about single rows, as rows may tie on id and text. So the rows are numbered once, in a
table that all later scans read: a number taken anew by a second scan may name another row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import ascii_lower, free_name, staged, text_of

PREFIX_CHARS = 64


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs as a table with a number for each row, and the name of its column. Numbers are places in
    the one scan that wrote the table."""
    rid = free_name(docs, "row_place")
    return staged(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered"), rid


def members(rows: DataFrame, rid: str, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows of a numbered table that have at least one exact copy: rid, doc_id, keep_id,
    group_size, kept.

    rid is the row's number. Texts are equal if identical after lower-casing A-Z; null is the empty
    text. Of equal texts the row with the largest doc_id stays; null ids are smallest, and of rows
    that tie on doc_id the one last in the scan stays. An empty table gives no rows.
    """
    rows = rows.select(F.col(rid).alias("rid"), "doc_id", text_of().alias("raw"))
    rows = rows.select("rid", "doc_id", "raw", F.octet_length("raw").alias("len"), F.xxhash64(ascii_lower(F.substring("raw", 1, prefix_chars))).alias("prefix"))

    by_length, by_prefix = F.xxhash64("len"), F.xxhash64("len", "prefix")
    lengths = sketch.build(rows.groupBy("len").count().where("count > 1"), by_length)
    prefixes = sketch.passing(rows.select("len", "prefix"), lengths, by_length).groupBy("len", "prefix").count().where("count > 1")
    hashed = sketch.passing(rows, sketch.build(prefixes, by_prefix), by_prefix).select("rid", "doc_id", F.sha2(ascii_lower(F.col("raw")), 256).alias("full"))
    hashed = staged(hashed.select("rid", "doc_id", F.unhex("full").alias("full")), "hashed")

    groups = hashed.groupBy("full").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("top")).where("group_size > 1")
    # As a table of its own, so that the join deals rows out anew and a large group may be split.
    found = hashed.join(staged(groups, "groups").hint("merge"), "full").select("rid", "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("top.rid")).alias("kept"))
    return staged(found, "members")


def exact_groups(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """docs with keep_id, group_size and kept on every row; see members() for the rules.

    Columns of docs that bear those names give way to the new ones. A row without a copy has its
    own doc_id as keep_id, group_size 1, kept true.
    """
    others = [c for c in docs.columns if c.lower() not in {"keep_id", "group_size", "kept"}]
    rows, rid = numbered(docs.select(*others))
    own, keep, size, kept = (free_name(rows, name) for name in ("of_row", "of_keep", "of_size", "of_kept"))
    found = members(rows, rid, prefix_chars).select(F.col("rid").alias(own), F.col("keep_id").alias(keep), F.col("group_size").alias(size), F.col("kept").alias(kept))
    met, alone = sketch.split(rows, F.xxhash64(rid), found.select(own), F.xxhash64(own))
    return (
        met.join(found, met[rid] == found[own], "left")
        .select(
            *others,
            F.when(F.col(size).isNull(), F.col("doc_id")).otherwise(F.col(keep)).alias("keep_id"),
            F.coalesce(size, F.lit(1).cast("long")).alias("group_size"),
            F.coalesce(kept, F.lit(True)).alias("kept"),
        )
        .union(alone.select(*others, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")))
    )


def drop_exact_copies(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """docs, all columns, with one row of each group of equal texts: the one with the largest doc_id."""
    rows, rid = numbered(docs)
    return sketch.without(rows, rid, members(rows, rid, prefix_chars).where("not kept").select("rid")).drop(rid)
