"""Mixing sources to target weights along a time-varying curriculum.

Only DataFrame functions are used. The training run is the interval 0 to 1. Every source has a
weight schedule, piecewise linear over that interval; the integral of the schedule, scaled so that
it ends at the source's target, is its cumulative demand of words. Documents of a source stand in
the order of a hash of their id. A document that fills the words [a, b) of that order takes the
position where the cumulative demand reaches the middle of them, i.e. the inverse of the demand.
Sorting by position (a range sort) gives the order of training.

Word offsets inside a source are prefix sums. A source may hold a third of all rows, so they are
made in two steps: rows fall into slots by their hash, about SLOT_ROWS rows each; a window runs
inside each (source, slot), and another over the slots' sums alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged, text_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2.0
SLOT_ROWS = 4096
#: Factors on a source's weight at times 0 and 1, by the place of its weight in WEIGHTS: the first
#: kind fades, the second is level, the third grows.
SCHEDULE = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def word_count(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size, n_rows) with rank: the source's place by code point, null last.

    The table has one row per source. Ranks come from a range sort: places inside each sorted
    partition plus the number of rows in the partitions before, so no task sees every source.
    """
    ordered = sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id())
    ordered = staged(ordered.withColumn("part", F.shiftright("place", 33)), "sources")
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    low = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(before, "part").select("source", "source_size", "n_rows", (low + F.col("before")).alias("rank"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """A row per source with its target.

    The sources share `share` times all sizes by weight; a target stops at `most` times its
    source's size and the excess goes to the others by weight, until none is above. That is
    target = min(most * size, level * weight) with one level for all; the level only rises from
    step to step, so each step is one small sum over the sources. If the sources can't take the
    whole share, all stop at their limit. Sources of size 0 get 0.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = staged(ranked_sources(sizes).withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "weighted")
    level = 0.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        row = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("full"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row["open"]:
            level = float("inf")
            break
        now = (share * row["all"] - row["full"]) / row["open"]
        if now <= level:
            break
        level = now
    capped = F.col("cap") if level == float("inf") else F.least("cap", F.lit(level) * F.col("weight"))
    return table.withColumn("target", capped.cast("double"))


def position(demand: Column, total: Column, start: Column, end: Column) -> Column:
    """The time at which a source whose factor runs from start to end linearly has used demand of total.

    The factor's integral to t is start*t + (end-start)*t*t/2, its whole (start+end)/2. The
    quadratic is solved in the form that is exact for level schedules too.
    """
    part = F.when(total > 0, F.least(F.lit(1.0), demand / total)).otherwise(0.0) * (start + end) / 2
    under = F.greatest(F.lit(0.0), start * start + 2 * (end - start) * part)
    return F.when(part > 0, 2 * part / (start + F.sqrt(under))).otherwise(0.0)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, schedule: tuple = SCHEDULE, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken, position, position_again.

    Every document is taken once, or whole passes over the source are made, while the target
    lasts; the document in which it runs out counts with the words up to there, so the words
    taken from a source are its target rounded to a word. position is where the first pass reads
    the document, position_again the second (null if there is none). Null texts have size 0; null
    sources form one source, last in rank; rows that are equal in all columns are told apart by
    their place in the scan, which must be a stable one (a stored table); other columns are
    ignored. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.col("doc_id"), F.lit(17)).alias("order"), F.monotonically_increasing_id().alias("rid"))
    rows = staged(rows, "sized")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    goal = staged(targets(sizes, weights, share, most), "targets").withColumn("slots", F.ceil(F.col("n_rows") / slot_rows))

    same = rows["source"].eqNullSafe(goal["source"])
    placed = rows.join(goal, same).select("rank", "source_size", "target", "slots", "doc_id", "size", "order", "rid")
    placed = placed.withColumn("slot", F.pmod(F.shiftright("order", 8), F.col("slots")))
    by_slot = placed.groupBy("rank", "slot").agg(F.sum("size").alias("slot_size"))
    earlier = Window.partitionBy("rank").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    by_slot = by_slot.select("rank", "slot", F.coalesce(F.sum("slot_size").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("rank", "slot").orderBy("order", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(by_slot, ["rank", "slot"]).withColumn("start", F.col("before") + F.col("within"))

    whole = F.floor(F.col("target") + 0.5)
    first = F.greatest(F.lit(0), F.least("size", whole - F.col("start")))
    passes = [F.greatest(F.lit(0), F.least("size", whole - F.col("start") - k * F.col("source_size"))) for k in range(1, int(-(-most // 1)))]
    taken = first
    for extra in passes:
        taken = taken + extra
    which = (F.col("rank") % len(weights) + 1).cast("int")
    start_factor = F.element_at(F.array(*[F.lit(float(s[0])) for s in schedule]), which)
    end_factor = F.element_at(F.array(*[F.lit(float(s[1])) for s in schedule]), which)
    middle = F.col("start") + F.col("size") / 2
    here = position(middle, F.col("target"), start_factor, end_factor)
    again = position(middle + F.col("source_size"), F.col("target"), start_factor, end_factor)
    return placed.select(
        "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"),
        F.when(first > 0, here).alias("position"),
        F.when(taken > first, again).alias("position_again"),
    )


def readings(docs: DataFrame, **kwargs) -> DataFrame:
    """doc_id, size, source_size, target, reading, taken, position: a row for each time that the mix
    reads a document (reading 1 or 2), range-sorted by position. taken are the words of that
    reading. Documents that are not taken have one row, reading 1, taken 0 and no position, at the end.
    """
    rows = mix(docs, **kwargs)
    first = F.least("size", "taken")
    each = F.array(
        F.struct(F.lit(1).alias("reading"), first.alias("taken"), F.col("position").alias("position")),
        F.struct(F.lit(2).alias("reading"), (F.col("taken") - first).alias("taken"), F.col("position_again").alias("position")),
    )
    each = F.filter(each, lambda x: (x["reading"] == 1) | x["position"].isNotNull())
    rows = rows.select("doc_id", "size", "source_size", "target", F.explode(each).alias("r")).select("doc_id", "size", "source_size", "target", "r.reading", "r.taken", "r.position")
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id", "reading")


def training_order(docs: DataFrame, **kwargs) -> DataFrame:
    """mix(), range-sorted by position: rows not taken come last, ties by doc_id."""
    return mix(docs, **kwargs).orderBy(F.col("position").asc_nulls_last(), "doc_id")
