"""Short forms of analysed messages: a batch's summary rows, indicator lists by kind, sentences on wording.

All are expressions over the wide row of a message; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import refdata as R
from ..functions import text as T
from .export import defanged

# The headings of an indicator list, in order.
HEADINGS = {"urls": ("URLs", "url"), "domains": ("Domains", "domain"), "ips": ("IPs", "ip"), "emails": ("Emails", "email")}

# How a sentence calls the categories of wording.
LABELS = {
    "urgency": "urgency", "authority": "authority", "financial": "financial", "credential": "credential", "bec": "payment fraud", "lure": "lure", "advancefee": "advance fee", "social": "social engineering",
    "extortion": "extortion",
}


def indicator_list(raw: bool = False) -> Column:
    """The indicators of an analysed message as text: a heading for each kind that has any, one indicator a
    line, an empty line between kinds; hashes of files last. Defanged unless raw."""

    def block(heading: str, values: Column) -> Column:
        return F.when(F.size(values) > 0, F.array_join(F.concat(F.array(F.lit(f"# {heading}")), values), "\n"))

    def values(field: str, kind: str) -> Column:
        own = F.transform(F.col("iocs")[field], lambda x: x["value"])
        return own if raw else F.transform(own, lambda v: defanged(F.lit(kind), v))

    blocks = [block(heading, values(field, kind)) for field, (heading, kind) in HEADINGS.items()]
    hashes = F.array_compact(F.flatten(F.transform("file_risks", lambda f: F.array(f["sha256"], f["md5"]))))
    return T.trimmed(F.concat_ws("\n\n", *blocks, block("File hashes", hashes)))


def summary_rows(analyzed: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """(msg_id, tier, score, sender, subject, top, error): a row for each analysed message with the first
    reason of its score; messages of rejects (msg_id, reason) have an error and nothing else."""
    h = F.col("headers")

    def said(value: Column, otherwise: str) -> Column:
        return F.when(F.coalesce(value, F.lit("")) == "", otherwise).otherwise(value)

    top = F.coalesce(F.try_element_at("reasons", F.lit(1)), F.lit(""))
    rows = analyzed.select("msg_id", "tier", "score", said(h["from"]["email"], "—").alias("sender"), said(h["subject"], "(no subject)").alias("subject"), top.alias("top"), F.lit(None).cast("string").alias("error"))
    if rejects is None:
        return rows
    return rows.unionByName(rejects.select("msg_id", F.col("reason").alias("error")), allowMissingColumns=True)


def some_names(items: Column, most: int = 3) -> Column:
    """The first values of an array of structs, without empty ones, joined by commas."""
    named = F.filter(F.transform(items, lambda x: x["value"]), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.array_join(F.slice(named, 1, most), ", ")


def wording_sentence(hits: Column) -> Column:
    """A sentence on the hits of a message: strong phrases by category, broad terms by number."""

    def count(test) -> Column:
        return F.size(F.filter(hits, test))

    def plural(n: Column, word: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))

    def part(category: str) -> Column:
        n = count(lambda m: (m["category"] == category) & (m["tier"] == "strong"))
        return F.when(n > 0, plural(n, f"{LABELS[category]} phrase"))

    strong = F.array_compact(F.array(*[part(c) for c in R.CATEGORY_WEIGHTS]))
    n_broad = count(lambda m: m["tier"] == "broad")
    also = F.when(n_broad > 0, F.concat(F.lit(" Also noted: "), plural(n_broad, "broader money, pressure or persuasion term"), F.lit("."))).otherwise("")
    first = F.when(F.size(strong) > 0, F.concat(F.lit("Detected: "), F.array_join(strong, ", "), F.lit("."))).otherwise("No suspicious phrases detected.")
    return F.concat(first, also)
