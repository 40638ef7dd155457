"""Correlation of messages by shared indicators, and side-by-side comparison as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import refdata


def indicators(rows: DataFrame, msg: str, values: dict[str, Column]) -> DataFrame:
    """(msg, type, value), one row for each distinct non-empty value of a message. A value may be
    an array column: each element counts."""
    parts = []
    for kind, value in values.items():
        parts.append(F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value")))
    long = rows.select(F.col(msg).alias("msg"), F.explode(F.array(*parts)).alias("i")).select("msg", "i.type", F.lower("i.value").alias("value"))
    return long.where("value <> ''").dropDuplicates(["msg", "type", "value"])


def shared(long: DataFrame) -> DataFrame:
    """type, value, weight, n_messages, first_seen of indicators in more than one message, those with
    most messages first, then the heavier type, then the first seen. members() says which they are."""
    weights = F.create_map(*[F.lit(x) for pair in refdata.INDICATOR_WEIGHTS.items() for x in pair])
    found = long.groupBy("type", "value").agg(F.count("*").alias("n_messages"), F.min("msg").alias("first_seen"))
    found = found.where("n_messages > 1").withColumn("weight", F.coalesce(F.try_element_at(weights, F.col("type")), F.lit(10)))
    return found.orderBy(F.desc("n_messages"), F.desc("weight"), "first_seen", "type", "value")


def members(long: DataFrame, found: DataFrame) -> DataFrame:
    """found (from shared) with msg: a row for each message of each shared indicator. One value may
    be in most messages, so no list is gathered, and adaptive execution may split the join."""
    own = long.select(F.col("type").alias("m_type"), F.col("value").alias("m_value"), "msg")
    return found.join(own, (found["type"] == own["m_type"]) & (found["value"] == own["m_value"])).drop("m_type", "m_value")


def with_precedence(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """keys with source, sources, rank, place: of the mentions (keys, source, rank, place) of each value
    the one of least rank, then the earliest, and the set of all sources, sorted. One aggregate, summed up
    before the shuffle; sources are a fixed few, so no list grows with the mentions."""
    best = F.min(F.struct("rank", "place", "source")).alias("best")
    found = mentions.groupBy(*keys).agg(best, F.sort_array(F.collect_set("source")).alias("sources"))
    return found.select(*keys, "best.source", "sources", "best.rank", "best.place")


def cells(rows: DataFrame, msg: str, properties: list[str]) -> DataFrame:
    """(property, msg, value): a row for each property of each message."""
    parts = [F.struct(F.lit(p).alias("property"), F.col(p).cast("string").alias("value")) for p in properties]
    return rows.select(F.col(msg).alias("msg"), F.explode(F.array(*parts)).alias("c")).select("c.property", "msg", "c.value")


def agreement(long: DataFrame) -> DataFrame:
    """For each property whether all of two or more messages have one value."""
    found = long.groupBy("property").agg(F.count("*").alias("n_cells"), F.countDistinct("value").alias("n_values"))
    return found.withColumn("identical", (F.col("n_values") == 1) & (F.col("n_cells") > 1))


def mark_shared(long: DataFrame, found: DataFrame, types: dict[str, str]) -> DataFrame:
    """cells with `shared`: whether the cell's value is a shared indicator of its property's type."""
    kind = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    keyed = long.withColumn("type", F.try_element_at(kind, F.col("property"))).withColumn("key", F.lower("value"))
    known = found.select(F.col("type").alias("s_type"), F.col("value").alias("s_value"))
    joined = keyed.join(known, (keyed["type"] == known["s_type"]) & (keyed["key"] == known["s_value"]), "left")
    return joined.select("property", "msg", "value", F.col("s_value").isNotNull().alias("shared"))
