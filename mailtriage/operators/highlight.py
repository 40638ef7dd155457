"""A message's text with its phrase matches marked, as escaped HTML.

Matches of several categories overlap; spans are their union, with all categories in the order in which
they begin. Everything is a fold over a message's own matches, sorted by place: no row is shuffled if the
matches are in the message's row, and matches() can be grouped into it by its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import let

_SPAN = "array<struct<start:int,stop:int,strong:boolean,categories:array<string>>>"


def spans(found: Column) -> Column:
    """array of struct(start, stop, strong, categories) from an array of struct(category, tier, idx,
    length): overlapping matches become one span, ones that only touch stay apart."""
    rows = F.transform(F.filter(found, lambda m: m["length"] > 0), lambda m: F.struct(m["idx"].cast("int").alias("start"), (m["idx"] + m["length"]).cast("int").alias("stop"), (m["tier"] == "strong").alias("strong"), F.array(m["category"]).alias("categories")))

    def add(done: Column, m: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        merged = F.struct(last["start"].alias("start"), F.greatest(last["stop"], m["stop"]).alias("stop"), (last["strong"] | m["strong"]).alias("strong"), F.array_union(last["categories"], m["categories"]).alias("categories"))
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(merged))
        return F.when((F.size(done) > 0) & (m["start"] < last["stop"]), grown).otherwise(F.concat(done, F.array(m))).cast(_SPAN)

    return F.aggregate(F.array_sort(rows), F.array().cast(_SPAN), add)


def escaped(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def highlighted(text: Column, marked: Column) -> Column:
    """Escaped text with a <mark> around each of its spans (from spans()): its class is the first
    category, its title all of them; one of broad words alone also has class `broad`."""

    def render(x: Column) -> Column:
        own, said = x["spans"], x["text"]

        def piece(s: Column, i: Column) -> Column:
            before = F.when(i > 0, F.try_element_at(own, i)["stop"]).otherwise(F.lit(0))
            kind = F.concat(F.lit("highlight-"), s["categories"][0], F.when(s["strong"], "").otherwise(" broad"))
            opened = F.concat(F.lit('<mark class="'), escaped(kind), F.lit('" title="'), escaped(F.array_join(s["categories"], ", ")), F.lit('">'))
            return F.concat(escaped(F.substr(said, before + 1, s["start"] - before)), opened, escaped(F.substr(said, s["start"] + 1, s["stop"] - s["start"])), F.lit("</mark>"))

        end = F.coalesce(F.try_element_at(own, F.lit(-1))["stop"], F.lit(0))
        return F.concat(F.array_join(F.transform(own, piece), ""), escaped(F.substr(said, end + 1)))

    return let(F.struct(F.coalesce(text, F.lit("")).alias("text"), marked.alias("spans")), render)


def highlighted_texts(texts: DataFrame, found: DataFrame) -> DataFrame:
    """texts (msg_id, text) with `highlighted`, from matches (msg_id, category, tier, idx, length) of
    those texts; msg_id must be unique in texts. Texts without a match are escaped. A text's matches are
    gathered in its row: they are no more than its words."""
    by_text = found.groupBy(F.col("msg_id").alias("m_id")).agg(F.collect_list(F.struct("category", "tier", "idx", "length")).alias("found"))
    rows = texts.join(by_text, texts["msg_id"].eqNullSafe(F.col("m_id")), "left")
    none = F.array().cast("array<struct<category:string,tier:string,idx:int,length:int>>")
    return rows.select("msg_id", "text", highlighted(F.col("text"), spans(F.coalesce("found", none))).alias("highlighted"))
