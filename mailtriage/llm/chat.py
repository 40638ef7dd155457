"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the
assistant and the others as named users; the mask marks the characters to learn from, those of the
assistant's own turns and their end marks. A conversation is never gathered in one row: the result
is a row for each turn and perspective with the turn's segment, its place in the rendered dialogue
and its masked part. Places are running sums made in two steps (inside the parts of a range sort,
then over the parts), so a conversation that holds a third of all rows is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_of

SYSTEM = "system"
OPEN, CLOSE = "<|", "|>"
END = "<|end|>\n"


def quoted(text: Column) -> Column:
    """Text in which no mark of the template can be forged: "<|" becomes "<\\|", "<\\" doubles its stroke."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit(OPEN), F.lit("<\\|"))


def unquoted(text: str) -> str:
    """The inverse of quoted()."""
    return text.replace("<\\|", OPEN).replace("<\\\\", "<\\")


def speaker(role: Column) -> Column:
    """A participant's name; a null role is the participant `unknown`."""
    return F.coalesce(role, F.lit("unknown"))


def running_start(rows: DataFrame, keys: list[str], size: str, order: list[Column], name: str) -> DataFrame:
    """rows (staged) with `name`: the sum of `size` over the rows before it that have its keys."""
    ordered = staged(rows.orderBy(*keys, *order).withColumn("place", F.monotonically_increasing_id()), "turns")
    ordered = ordered.withColumn("part", F.shiftright("place", 33))
    before = Window.unboundedPreceding, -1
    inside = Window.partitionBy(*keys, "part").orderBy("place").rowsBetween(*before)
    parts = ordered.groupBy(*keys, "part").agg(F.sum(size).alias("part_size"))
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part_size").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(*before)), F.lit(0))).drop("part_size")
    for k in keys:
        parts = parts.withColumnRenamed(k, f"{k}_of")
    parts = parts.withColumnRenamed("part", "part_of")
    inner = ordered.withColumn("within", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    same = inner["part"] == parts["part_of"]
    for k in keys:
        same = same & inner[k].eqNullSafe(parts[f"{k}_of"])
    joined = inner.join(parts, same)
    return joined.withColumn(name, F.col("within") + F.col("ahead")).drop("place", "part", "within", "ahead", "part_of", *[f"{k}_of" for k in keys])


def perspectives(conversations: DataFrame) -> DataFrame:
    """conv_id, assistant, turn, speaker, segment, start, end, learn_from, learn_to.

    A row for each turn and participant. start and end are the segment's place in the dialogue as
    that participant sees it, learn_from and learn_to (null in other speakers' turns) the masked
    part, in code points, ends exclusive. Turns with role `system` are instructions and nobody's
    perspective; a conversation of such turns alone gives no rows. Turns stand by number (null
    first), ties by role and text; repeated turns stay. Null roles are the participant `unknown`,
    null texts are empty, rows with a null conv_id form one conversation; other columns are ignored.
    """
    turns = conversations.select("conv_id", "turn", speaker(F.col("role")).alias("speaker"), quoted(text_of()).alias("body"))
    turns = turns.withColumn("name", quoted(F.regexp_replace("speaker", r"[|\n]", " ")))
    people = turns.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of_conv"), F.col("speaker").alias("assistant")).distinct()
    seen = turns.join(people, turns["conv_id"].eqNullSafe(people["of_conv"])).drop("of_conv")
    own = F.col("speaker") == F.col("assistant")
    head = F.when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), F.col("name"), F.lit("|>\n")))
    seen = seen.withColumn("segment", F.concat(head, F.col("body"), F.lit(END))).withColumn("size", F.length("segment").cast("long"))
    seen = seen.withColumn("head_size", F.length(head)).drop("body", "name")
    placed = running_start(seen, ["conv_id", "assistant"], "size", [F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("segment")], "start")
    return placed.select(
        "conv_id", "assistant", "turn", "speaker", "segment", "start", (F.col("start") + F.col("size")).alias("end"),
        F.when(F.col("speaker") == F.col("assistant"), F.col("start") + F.col("head_size")).alias("learn_from"),
        F.when(F.col("speaker") == F.col("assistant"), F.col("start") + F.col("size")).alias("learn_to"),
    )
