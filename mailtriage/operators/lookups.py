"""Rules about lookup answers. Nothing is fetched here: a provider fills a table of answers, and these
expressions judge it. missing() says what is still to be asked, each target once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net

DOMAIN = r"\A(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}\z"


def valid_domain(value: Column) -> Column:
    return F.coalesce(F.lower(value).rlike(DOMAIN), F.lit(False))


def valid_target(kind: Column, value: Column) -> Column:
    """Whether a target may be asked for: a domain, or an address that is routable."""
    return F.when(kind == "domain", valid_domain(value)).when(kind == "ip", net.routable_ip(value)).otherwise(False)


def reputation(malicious: Column, suspicious: Column) -> Column:
    """The verdict of engines' counts; null without an answer."""
    return F.when(malicious > 0, "malicious").when(suspicious > 0, "suspicious").when(malicious.isNotNull(), "clean")


def abuse_level(confidence: Column) -> Column:
    return F.when(confidence >= 50, "high").when(confidence >= 25, "elevated").when(confidence.isNotNull(), "low")


def domain_age(created: Column, today: Column) -> Column:
    """A domain is bad in its first 30 days and to be watched up to 180."""
    days = F.datediff(today, created)
    return F.when(days <= 30, "bad").when(days <= 180, "warn").when(days.isNotNull(), "fine")


def dmarc_strength(policy: Column) -> Column:
    return F.when(F.lower(policy).isin("reject", "quarantine"), "good").when(F.lower(policy) == "none", "weak").otherwise("missing")


def spf_strength(record: Column) -> Column:
    low = F.lower(record)
    return F.when(low.rlike(r"-all\s*\z"), "strict").when(low.rlike(r"~all\s*\z"), "soft").when(low.isNotNull(), "open").otherwise("missing")


def missing(targets: DataFrame, answers: DataFrame) -> DataFrame:
    """The distinct (kind, value) of targets that answers (kind, value, ok) hold no good answer for."""
    known = answers.where("ok").select("kind", "value").distinct()
    asked = targets.select("kind", F.lower("value").alias("value")).where(valid_target(F.col("kind"), F.col("value"))).distinct()
    return asked.join(known, ["kind", "value"], "left_anti")
