"""Connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _stars(edges: DataFrame, smaller: bool) -> DataFrame:
    """One step. Each node links its neighbours (the greater ones, or in the small step the lesser
    ones and itself) to the least node among its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if smaller:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("low"))
    met = both.join(least, both["a"] == least["node"])
    if smaller:
        out = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("low").alias("b")))
    else:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b) that isn't the least of its component; label is that least node.

    Edges are longs, either way round; loops and repeats don't matter; no edges give no rows. Each
    round writes its edges as a table; the driver sees a count and a checksum only.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        seen = now
        edges = staged(_stars(_stars(edges, smaller=False), smaller=True), "edges")
