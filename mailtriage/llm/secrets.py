"""Secret scanning with a trigram inverted index. Only DataFrame functions run on the data.

1. Each rule's regular expression gives a Boolean trigram query (trigrams.py), on the driver.
2. One scan writes the inverted index: a posting (trigram, document key) for every trigram that
   some rule asks for and the document holds. Common prose holds few of them, so the index is small.
3. A rule's alternatives intersect their trigrams' postings: postings meet the (trigram, alternative)
   table, are counted per (document, alternative), and a document whose count reaches the
   alternative's number of trigrams is a candidate of the rule.
4. Candidates reach the scan of the texts as a key sketch (sketch.py), of fixed size and broadcast
   whatever their number, so no text is shuffled. A rule's expression verifies the texts that the
   sketch lets pass, few of them by chance, in place and whole. Rules without mandatory trigrams
   are verified on every text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import ascii_lower, staged, text_of
from .trigrams import query_of


@dataclass(frozen=True)
class Rule:
    """pattern must mean the same in Java's and Python's syntax; a match counts if the group's
    text has at least `least` characters (code points)."""

    kind: str
    pattern: str
    group: int
    least: int


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # As [0-9a-f]+ of 24 characters or more: a match of the longer form is a whole run.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)

#: Matches whose places are summed in one step.
BLOCK = 256


def alternatives(rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, str]]:
    """(rule, alternative, trigram) of all rules that have a query."""
    found = []
    for r, rule in enumerate(rules):
        for a, grams in enumerate(query_of(rule.pattern) or []):
            found += [(r, a, g) for g in sorted(grams)]
    return found


def _key(docs: DataFrame) -> list[Column]:
    """Rows of one doc_id and one text share their fate; null ids are fine."""
    return [F.coalesce(F.xxhash64("doc_id"), F.lit(0)).alias("k_id"), F.xxhash64("doc_id", "text").alias("k_text")]


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index (trigram, k_id, k_text) over the trigrams that the rules ask for."""
    grams = sorted({g for _, _, g in alternatives(rules)})
    rows = docs.select(*_key(docs), ascii_lower(text_of()).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams])) if grams else F.array().cast("array<string>")
    return staged(rows.select("k_id", "k_text", F.explode(held).alias("trigram")), "postings")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(k_id, k_text, rule): the rules whose query a document's postings satisfy, each once."""
    spark = index.sparkSession
    wanted = alternatives(rules)
    table = spark.createDataFrame(wanted or [(0, 0, "")], "rule int, alternative int, trigram string")
    needed = table.groupBy("rule", "alternative").agg(F.count("*").alias("needed"))
    # Both tables have one row per trigram of the rules: their size is fixed by the rules.
    hits = index.distinct().join(F.broadcast(table), "trigram").groupBy("k_id", "k_text", "rule", "alternative").agg(F.count("*").alias("n"))
    met = hits.join(F.broadcast(needed), ["rule", "alternative"]).where("n = needed")
    return met.select("k_id", "k_text", "rule").distinct()


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) in code points: leftmost matches, without overlap.

    The pieces between matches come from split, the matches from regexp_extract_all; running sums
    of their lengths give the places. A sum that carries its matches along copies them with each
    step, so it runs inside blocks of BLOCK matches, and then over the blocks.
    """
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    match = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x))
    value = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x)) if rule.group else match
    steps = F.arrays_zip(between.alias("b"), match.alias("m"), value.alias("v"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(between) - 1) / BLOCK).cast("int")), lambda j: F.slice(steps, j * BLOCK + 1, BLOCK))
    empty = F.array().cast("array<struct<start:int,number:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["b"]
        end = begin + F.coalesce(x["m"], F.lit(0))
        hit = F.array(F.struct(begin.alias("start"), F.lit(number).alias("number"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["v"] >= rule.least, F.concat(state["found"], hit)).otherwise(state["found"]).alias("found"))

    def append(state: Column, x: Column) -> Column:
        at = state["at"]
        moved = F.transform(x["found"], lambda y: F.struct((y["start"] + at).alias("start"), y["number"].alias("number"), (y["end"] + at).alias("end")))
        return F.struct((at + x["at"]).alias("at"), F.concat(state["parts"], F.array(moved)).alias("parts"))

    within = F.transform(blocks, lambda block: F.aggregate(block, start, step))
    whole = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,number:int,end:int>>>").alias("parts"))
    counted = F.regexp_count(text, pattern) > 0
    return F.when(counted, F.aggregate(within, whole, append, lambda s: F.flatten(s["parts"]))).otherwise(empty)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs' doc_id with secrets: array of (kind, start, end) by start, then rule order.

    One row per row of docs, those without a secret included (empty array). Null text is empty;
    null ids and repeated rows are kept as they are; other columns are ignored; an empty table
    gives no rows. Overlapping matches of different kinds all stay.
    """
    full = [r for r, rule in enumerate(rules) if query_of(rule.pattern) is None]
    key = F.xxhash64("k_id", "k_text")
    found = sketch.build(candidates(build_index(docs, rules), rules), key, F.col("rule"))
    rows, bits = sketch.attach(docs.select("doc_id", text_of().alias("whole"), *_key(docs)), found, key)
    empty = F.array().cast("array<struct<start:int,number:int,end:int>>")
    parts = []
    for r, rule in enumerate(rules):
        here = spans(F.col("whole"), rule, r)
        parts.append(here if r in full else F.when(sketch.may_hold(bits, key, F.lit(r)), here).otherwise(empty))
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    merged = rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("merged"))
    return merged.select(
        "doc_id",
        F.transform("merged", lambda x: F.struct(F.element_at(kinds, x["number"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("secrets"),
    )


def joined(secrets: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(secrets, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
