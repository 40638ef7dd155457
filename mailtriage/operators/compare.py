"""Side-by-side comparison of analysed messages.

A comparison is a long table, a row for each property of each message, so any number of messages can
be compared by aggregation. Only a table or CSV that names its messages is wide.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import export, language

# What stands for nothing, the properties whose values are indicators, with their type,
# and the types of indicators that tie messages together by themselves.
DASH = "—"
CORRELATED = {
    "from": "from", "from_domain": "domain", "display_name": "displayName", "reply_to": "replyTo", "subject": "subject", "sender_ip": "ip",
    "message_id_domain": "messageIdDomain", "mailer": "mailer", "hashes": "hash",
}
STRONG_LINKS = ("hash", "ip", "url", "urlDomain", "from", "replyTo")
#: Link domains that a cell shows; further ones are counted.
SHOWN_DOMAINS = 6


def status_tone(status: Column) -> Column:
    return F.when(status == "pass", "good").when(status == "fail", "bad").when(status.isin("softfail", "permerror", "unverified"), "warn").otherwise("muted")


def _listed(items: Column, separator: str, none: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, separator)).otherwise(none)


def _any(test: Column, tone: str) -> Column:
    return F.when(test, tone).otherwise("muted")


def properties(only: Collection[str] | None = None) -> Column:
    """array of struct(ord, c) of an analysed message, c a struct(property, value, tone, keys): tone is
    null where a property is neither good nor bad, keys are the indicators that the value holds. With
    only, what the other properties need is not computed."""
    h, urls, files, findings = F.col("headers"), F.col("iocs.urls"), F.col("file_risks"), F.col("findings")
    none = F.array().cast("array<string>")

    def shown(value: Column) -> Column:
        return F.coalesce(F.nullif(value, F.lit("")), F.lit(DASH))

    def one(name: str, value: Column, tone: Column | None = None, keys: Column | None = None) -> tuple[str, Column]:
        return name, F.struct(F.lit(name).alias("property"), value.alias("value"), (F.lit(None).cast("string") if tone is None else tone).alias("tone"), (none if keys is None else keys).alias("keys"))

    def indicator(name: str, value: Column, key: Column | None = None) -> tuple[str, Column]:
        return one(name, shown(value), keys=F.filter(F.array(F.lower(value if key is None else key)), lambda x: x != ""))

    quoted = F.filter(findings, lambda f: f["module"] == "thread")
    deceit = F.filter(findings, lambda f: f["module"] != "thread")

    def high(found: Column) -> Column:
        return F.exists(found, lambda f: f["severity"] == "high")

    n_quoted, n_signs = F.size("quoted"), F.size(F.filter(quoted, lambda f: f["severity"] == "high"))
    thread = F.concat(n_quoted.cast("string"), F.lit(" quoted"), F.when(n_signs > 0, F.concat(F.lit(", signs of fabrication: "), n_signs.cast("string"))).otherwise(""))
    hosts = F.array_distinct(F.filter(F.transform(urls, lambda u: u["host"]), lambda x: x != ""))
    more = F.size(hosts) - SHOWN_DOMAINS
    domains = F.concat(F.array_join(F.slice(hosts, 1, SHOWN_DOMAINS), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(""))
    deceptive = F.size(F.filter(urls, lambda u: u["mismatch"]))
    hashes = F.filter(F.transform(files, lambda f: f["sha256"]), lambda x: x.isNotNull())
    worded = F.transform(F.array_sort(F.filter(F.map_entries("strong"), lambda e: e["value"] > 0)), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string")))
    pressing = (language.strong_count(F.col("strong"), "bec") >= 2) | (language.strong_count(F.col("strong"), "extortion") >= 2) | (language.strong_count(F.col("strong"), "advancefee") >= 3)
    seals = F.size(F.array_distinct(F.transform(F.filter(h["ordered"], lambda x: x["key"] == "arc-seal"), lambda x: F.regexp_extract(x["value"], r"(?i)\bi\s*=\s*([0-9]+)", 1))))
    aligned = F.col("alignment.dmarc_aligned")
    sender = h["from"]["email"]
    listed = (
        one("verdict", F.concat(F.col("tier"), F.lit(" · "), F.col("score").cast("string"), F.lit("/100")), F.when(F.col("tier") == "High Risk", "bad").when(F.col("tier") == "Suspicious", "warn").otherwise("good")),
        one("attack_types", _listed(F.col("attack_types"), ", ", DASH), _any(F.size("attack_types") > 0, "bad")),
        one("top_reason", shown(F.try_element_at("reasons", F.lit(1)))),
        *[one(m, F.upper(F.coalesce(F.col(m)["status"], F.lit("unknown"))), status_tone(F.coalesce(F.col(m)["status"], F.lit("unknown")))) for m in ("spf", "dkim", "dmarc")],
        one("alignment", F.when(aligned, "Aligned").when(~aligned, "Not aligned").otherwise("No data"), F.when(aligned, "good").when(~aligned, "bad").otherwise("muted")),
        one("identity", _listed(F.transform(deceit, lambda f: f["title"]), "; ", "None"), _any(high(deceit), "bad")),
        one("thread", F.when(n_quoted > 0, thread).otherwise("None"), _any(high(quoted), "bad")),
        indicator("from", sender), indicator("from_domain", F.lower(F.substring_index(sender, "@", -1))), indicator("display_name", h["from"]["name"]), indicator("reply_to", h["reply_to"]["email"]),
        one("return_path", shown(h["return_path"]["email"])), indicator("subject", h["subject"], T.subject_key(h["subject"])), one("date", shown(h["date"])),
        indicator("sender_ip", F.col("sender_ip.public_ip")), one("origin_host", shown(F.col("sender_ip.public_host"))), indicator("message_id_domain", F.regexp_extract(h["message_id"], r"@([^>\s]+)", 1)), indicator("mailer", h["x_mailer"]),
        one("link_count", F.size(urls).cast("string")), one("link_domains", shown(domains)), one("deceptive_links", deceptive.cast("string"), _any(deceptive > 0, "bad")),
        one("attachments", _listed(F.transform(files, lambda f: f["value"]), ", ", "None"), _any(F.exists(files, lambda f: T.risky_extension(T.stripped(f["value"]))), "bad")),
        one("hashes", _listed(hashes, ", ", DASH), keys=hashes), one("language", _listed(worded, "; ", "None"), _any(pressing, "bad")),
        one("anomalies", _listed(F.transform("anomalies", lambda x: x["message"]), " ", "None"), _any(F.size("anomalies") > 0, "warn")),
        one("trust", F.when(F.size("trust.warnings") > 0, F.size("trust.warnings").cast("string")).otherwise("None"), _any(F.size("trust.warnings") > 0, "bad")),
        one("arc", F.when(seals > 0, F.concat(seals.cast("string"), F.lit(" set(s)"))).otherwise("None")),
    )
    return F.array(*[F.struct(F.lit(i).alias("ord"), c.alias("c")) for i, (name, c) in enumerate(listed) if only is None or name in only])


def cells(analyzed: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """(ord, property, msg, value, tone, keys): a row for each of 29 properties of each message, or of
    those in only."""
    # explode() would get a filter below it that computes the array once more; no message has an empty one.
    rows = analyzed.select(F.col("msg_id").alias("msg"), F.explode_outer(properties(only)).alias("p"))
    return rows.select("p.ord", "p.c.property", "msg", "p.c.value", "p.c.tone", "p.c.keys")


def mark_shared(compared: DataFrame, found: DataFrame) -> DataFrame:
    """cells with `shared` in place of keys: whether the cell holds an indicator of found (from
    correlate.shared). Cells of equal (property, msg) are one message's: msg must be unique."""
    kind = F.create_map(*[F.lit(x) for pair in CORRELATED.items() for x in pair])
    held = compared.select(F.col("property").alias("s_property"), F.col("msg").alias("s_msg"), F.try_element_at(kind, F.col("property")).alias("type"), F.explode("keys").alias("value"))
    known = held.join(found.select("type", "value"), ["type", "value"], "left_semi").select("s_property", "s_msg").distinct()
    joined = compared.join(known, (compared["property"] == known["s_property"]) & (compared["msg"] == known["s_msg"]), "left")
    return joined.select("ord", "property", "msg", "value", "tone", F.col("s_msg").isNotNull().alias("shared"))


def strong_links(found: DataFrame) -> DataFrame:
    """The shared indicators of types that tie messages together by themselves."""
    return found.where(F.col("type").isin(*STRONG_LINKS))


def wide(compared: DataFrame, msgs: list, differing_only: bool = False) -> DataFrame:
    """(ord, property, identical, a column for each of msgs): the comparison that a person reads. The
    messages are named, so the width is the caller's; differing_only leaves out rows that agree."""
    few = compared.where(F.col("msg").isin(*msgs))
    n = F.count("*")
    agree = few.groupBy("ord", "property").agg(((F.countDistinct("value") == 1) & (n > 1)).alias("identical"))
    rows = few.groupBy("ord", "property").pivot("msg", msgs).agg(F.first("value"))
    rows = agree.join(rows, ["ord", "property"])
    return rows.where("not identical") if differing_only else rows


def csv_lines(table: DataFrame, msgs: list) -> DataFrame:
    """(ord, line) of a table from wide(): the heading at -1, then a line for each property."""
    spark = table.sparkSession
    heading = ",".join(str(m) for m in ["property", *msgs])
    if any(c in heading for c in '"\r\n') or heading.count(",") != len(msgs):
        raise ValueError("message ids of a CSV heading hold no commas, quotes or line breaks")
    body = table.select("ord", F.concat_ws(",", *[export.csv_cell(F.col(f"`{c}`")) for c in ["property", *map(str, msgs)]]).alias("line"))
    return spark.createDataFrame([(-1, heading)], "ord int, line string").unionByName(body)


def json_documents(analyzed: DataFrame) -> DataFrame:
    """(msg, object): each message's verdict, score and properties as JSON; nothing is shuffled."""
    named = F.map_from_entries(F.transform(properties(), lambda p: F.struct(p["c"]["property"], p["c"]["value"])))
    return analyzed.select(F.col("msg_id").alias("msg"), F.to_json(F.struct(F.col("msg_id").cast("string").alias("name"), F.col("tier").alias("verdict"), "score", named.alias("properties"))).alias("object"))

