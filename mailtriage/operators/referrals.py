"""WHOIS answers and the referrals between servers.

A registry's answer may name another server that knows more. follow() walks these referrals over a table
of answers: each round joins the questions that are open with their answers, reads the server each one
refers to, and drops servers that a target has asked before; the questions of the next round are written
as a table, so lineage stays one round long and a lost executor repeats one round. The walk ends when no
question is open, which the cycle check guarantees. All targets advance together: rounds number as the
longest chain, not as the targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

ROOT = "whois.iana.org"
#: A chain longer than this is cut, and says so.
MOST_ROUNDS = 16

# Names of fields in answers, the better ones first.
FIELDS = {
    "target": ("Domain Name", "domain", "inetnum", "NetRange"),
    "registrar": ("Registrar", "Sponsoring Registrar"),
    "registrant": ("Registrant Organization", "Registrant Name", "org-name", "OrgName", "descr"),
    "country": ("Registrant Country", "country"),
    "registered": ("Creation Date", "created", "Registered On", "RegDate"),
    "updated": ("Updated Date", "last-modified", "Last Modified"),
    "expires": ("Registry Expiry Date", "Expiry Date", "expires", "paid-till"),
    "abuse_email": ("Registrar Abuse Contact Email", "abuse-mailbox", "OrgAbuseEmail"),
}
# How answers say that nothing is registered, and how they name another server.
NOT_FOUND = ("no match", "not found", "no entries found", "no data found", "domain not found")
REFERRALS = ("refer", "whois", "Registrar WHOIS Server")


def field(text: Column, *names: str) -> Column:
    """The value of the first of some fields that an answer has, in the order of names; null without."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^[ \t]*{name}[ \t]*:[ \t]*(\S[^\r\n]*)", 1)), F.lit("")) for name in names])


def every(text: Column, *names: str) -> Column:
    """The values of all lines with one of some fields, in the order of the answer."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?im)^[ \t]*(?:{'|'.join(names)})[ \t]*:[ \t]*(\S[^\r\n]*)"), F.lit(1)), lambda v: F.trim(v))


def not_found(text: Column) -> Column:
    return F.coalesce(text.rlike(rf"(?im)^\s*(?:{'|'.join(NOT_FOUND)})"), F.lit(False))


def referred(text: Column) -> Column:
    """The server that an answer refers to, lower-case, or null."""
    return F.lower(F.regexp_extract(field(text, *REFERRALS), r"\A(?:r?whois://)?([^\s/:]+)", 1))


def summary(text: Column) -> Column:
    """struct(not_found, target, registrar, ..., statuses, nameservers) of an answer. An answer that finds
    nothing has no values."""
    gone = not_found(text)
    values = [F.when(~gone, field(text, *names)).alias(name) for name, names in FIELDS.items()]
    none = F.array().cast("array<string>")
    hosts = F.transform(every(text, "Name Server", "nserver", "nameserver"), lambda v: F.lower(F.regexp_extract(v, r"\A(\S+)", 1)))
    return F.struct(gone.alias("not_found"), *values, F.when(gone, none).otherwise(every(text, "Domain Status", "status")).alias("statuses"), F.when(gone, none).otherwise(hosts).alias("nameservers"))


def follow(targets: DataFrame, answers: DataFrame, root: str = ROOT, most: int = MOST_ROUNDS) -> DataFrame:
    """targets (value) to (value, servers, server, text, ended): each distinct target's chain of servers
    in order, the last one that answered, its answer, and why the chain ended: `answer` (no further
    referral), `cycle` (a server that was asked before), `missing` (the next server's answer is not in
    the table; the one before counts) or `cut` (more than `most` servers).

    answers holds (server, query, text); of several answers to a question the least text counts. The root
    is asked for a target's last label (an address is asked whole), others for the target. Null targets
    are left out. A target that the root has no answer for has no server and text.
    """
    known = answers.where("text is not null").groupBy(F.lower("server").alias("a_server"), F.lower("query").alias("a_query")).agg(F.min("text").alias("a_text"))
    known = staged(known, "whois-answers")
    value = F.lower(F.trim("value"))
    last = F.when(value.rlike(r"\A[0-9.]+\z") | value.contains(":"), value).otherwise(F.substring_index(value, ".", -1))
    none = F.array().cast("array<string>")
    start = targets.select(value.alias("value")).where("value <> ''").distinct()
    open_ = staged(start.select("value", F.lit(root).alias("next"), last.alias("query"), none.alias("servers"), F.lit(None).cast("string").alias("text")), "whois-open")
    done: DataFrame | None = None

    def ended(rows: DataFrame, why: Column) -> DataFrame:
        return rows.select("value", "servers", F.try_element_at("servers", F.lit(-1)).alias("server"), "text", why.alias("ended"))

    for turn in range(1, most + 1):
        # Answers are read from a table of their own: each round is one equi-join.
        met = open_.join(known, (F.col("next") == F.col("a_server")) & (F.col("query") == F.col("a_query")), "left")
        met = met.withColumn("answered", F.col("a_text").isNotNull())
        met = met.withColumn("servers", F.when(F.col("answered"), F.concat("servers", F.array("next"))).otherwise(F.col("servers"))).withColumn("text", F.coalesce("a_text", "text"))
        met = met.withColumn("further", F.nullif(referred(F.col("a_text")), F.lit("")))
        again = F.array_contains("servers", F.col("further"))
        why = F.when(~F.col("answered"), "missing").when(F.col("further").isNull(), "answer").when(again, "cycle")
        met = staged(met.withColumn("why", why).select("value", "servers", "text", "further", "why"), "whois-round")
        closed = ended(met.where("why is not null"), F.col("why"))
        done = closed if done is None else done.unionByName(closed)
        open_ = met.where("why is null").select("value", F.col("further").alias("next"), F.col("value").alias("query"), "servers", "text")
        if open_.isEmpty():
            return done
    return done.unionByName(ended(open_, F.lit("cut"))) if done is not None else ended(open_, F.lit("cut"))
