"""The risk score: capped parts, weighted sum, floors, tiers and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import refdata as R
from ..functions.text import half_up
from ..session import staged


def clamped(points: Column) -> Column:
    return F.greatest(F.lit(0), F.least(half_up(points), F.lit(100)))


def tier(points: Column) -> Column:
    return F.when(points >= R.TIER_HIGH, "High Risk").when(points >= R.TIER_SUSPICIOUS, "Suspicious").otherwise("Low Risk")


def total(auth: Column, iocs: Column, language: Column) -> Column:
    """The weighted sum of three capped parts, rounded half up."""
    return half_up(F.least(clamped(auth) * 0.6 + clamped(iocs) * 0.25 + clamped(language) * 0.15, F.lit(100.0)))


def points_of(status: Column, points: dict[str, int]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in points.items() for x in p]), status), F.lit(0))


def tier_rank(column: Column) -> Column:
    return F.when(column == "High Risk", 0).when(column == "Suspicious", 1).when(column == "Low Risk", 2).otherwise(3)


def ranked(scored: DataFrame, msg: str) -> DataFrame:
    """scored (msg, score, tier) with its place in the batch: by tier, then score, then msg.

    Places come from a range sort and the sizes of its parts, so no task sees the whole batch. The
    sorted rows are written as a table first: a lost executor can't number them anew.
    """
    order = [tier_rank(F.col("tier")), F.desc("score"), F.col(msg)]
    place = scored.repartitionByRange(*[c if isinstance(c, Column) else F.col(c) for c in order]).sortWithinPartitions(*order)
    place = place.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    place = staged(place, "ranked")
    sizes = place.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part of the sort
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    low = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return place.join(F.broadcast(sizes), "part").select(*scored.columns, (low + F.col("before") + 1).alias("place"))
