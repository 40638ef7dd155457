"""Exports of analysed messages as rows: defanged indicator tables, CSV lines, STIX and MISP objects.

Everything is a Column expression, so a campaign of any size is written by a distributed sink: one
row for each indicator or object, one document for each message only where a consumer asks for it.
Ids are name-based (UUID version 5) throughout, so that equal inputs give equal exports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The name space of STIX 2.1 observable ids, and the CSV columns.
STIX_NAMESPACE = "00abedb4aa42466c9c01fed23315a9b7"
CSV_COLUMNS = "type indicator source risk_flags details virustotal abuseipdb registration".split()


def uuid5(name: Column, namespace: str = STIX_NAMESPACE) -> Column:
    """The UUID of a name, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substr(h, F.lit(17), F.lit(1)), "0123456789abcdef", "89ab89ab89ab89ab")
    parts = [F.substr(h, F.lit(1), F.lit(8)), F.substr(h, F.lit(9), F.lit(4)), F.concat(F.lit("5"), F.substr(h, F.lit(14), F.lit(3))), F.concat(variant, F.substr(h, F.lit(18), F.lit(3))), F.substr(h, F.lit(21), F.lit(12))]
    return F.concat_ws("-", *parts)


def json_string(value: Column) -> Column:
    """A text as JSON writes it."""
    return F.regexp_replace(F.to_json(F.array(value)), r"\A\[|\]\z", "")


def defanged(kind: Column, value: Column) -> Column:
    return F.when(kind == "url", T.defang_url(value)).when(kind == "ip", T.defang_ip(value)).when(kind == "email", T.defang_email(value)).when(kind == "domain", T.defang_domain(value)).otherwise(value)


def csv_cell(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula, quoted where needed."""
    s = F.coalesce(value, F.lit(""))
    s = F.when(s.rlike(r"\A[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)
    return F.when(s.rlike('[",\r\n]') | (s != T.trimmed(s)), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def report_rows(analyzed: DataFrame) -> DataFrame:
    """(msg_id, ord, type, value, indicator, risk_flags, details, high): a row for each indicator."""
    none = F.array().cast("array<string>")

    def item(kind: str, value: Column, risks: Column, details: Column, high: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), value.alias("value"), risks.alias("risks"), details.alias("details"), high.alias("high"))

    def kinds_of(x: Column) -> Column:
        return F.transform(x["risks"], lambda r: r["type"])

    def is_high(x: Column) -> Column:
        return F.exists(x["risks"], lambda r: r["level"] == "high")

    empty, no = F.lit(""), F.lit(False)
    items = F.concat(
        F.transform(F.col("iocs.urls"), lambda u: item("url", u["value"], kinds_of(u), empty, is_high(u))),
        F.transform(F.col("iocs.domains"), lambda d: item("domain", d["value"], F.when(d["punycode"], F.array(F.lit("punycode"))).otherwise(none), empty, d["punycode"])),
        F.transform(F.col("iocs.ips"), lambda i: item("ip", i["value"], none, F.when(i["private"], "private/reserved address").otherwise(""), no)),
        F.transform(F.col("iocs.emails"), lambda e: item("email", e["value"], F.when(e["disposable"], F.array(F.lit("disposable"))).otherwise(none), empty, no)),
        F.transform(F.col("file_risks"), lambda f: item("filename", f["value"], kinds_of(f), F.coalesce(f["sniffed"], empty), is_high(f))),
        F.transform(F.col("file_risks"), lambda f: item("sha256", f["sha256"], kinds_of(f), F.concat(F.lit("file: "), f["value"]), is_high(f))),
        F.transform(F.col("file_risks"), lambda f: item("md5", f["md5"], kinds_of(f), F.concat(F.lit("file: "), f["value"]), is_high(f))),
    )
    rows = analyzed.select("msg_id", F.posexplode(items).alias("ord", "i")).select("msg_id", "ord", "i.*")
    return rows.select("msg_id", "ord", "type", "value", defanged(F.col("type"), F.col("value")).alias("indicator"), F.array_join("risks", "; ").alias("risk_flags"), "details", "high")


def csv_lines(report: DataFrame, enrichment: DataFrame | None = None) -> DataFrame:
    """(msg_id, ord, line): the CSV line of each indicator; enrichment (kind, value, summary) fills
    the lookup columns, of several answers for one value with the least."""
    rows = report.withColumns({"virustotal": F.lit(""), "abuseipdb": F.lit(""), "registration": F.lit("")})
    if enrichment is not None:
        by = enrichment.groupBy("value").pivot("kind", ["vt", "abuse", "whois"]).agg(F.min("summary")).withColumnRenamed("value", "of_value")
        rows = report.join(by, report["value"] == by["of_value"], "left").withColumnsRenamed({"vt": "virustotal", "abuse": "abuseipdb", "whois": "registration"})
    cells = [F.col("type"), F.col("indicator"), F.lit("Message"), F.col("risk_flags"), F.col("details"), F.col("virustotal"), F.col("abuseipdb"), F.col("registration")]
    return rows.select("msg_id", "ord", F.concat_ws(",", *[csv_cell(c) for c in cells]).alias("line"))


def csv_documents(lines: DataFrame) -> DataFrame:
    """(msg_id, csv): the report of each message, with byte-order mark, header and CRLF."""
    head = "﻿" + ",".join(CSV_COLUMNS)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\r\n")
    return lines.groupBy("msg_id").agg(F.concat(F.lit(head + "\r\n"), body, F.lit("\r\n")).alias("csv"))


def stix_objects(report: DataFrame, at: str) -> DataFrame:
    """(msg_id, id, type, object): STIX 2.1 observables and indicators as JSON, an id once for each
    message. Private addresses give none. at is the time that the objects bear."""
    kind = F.col("type")
    stix = F.when(kind == "url", "url").when(kind == "domain", "domain-name").when(kind == "email", "email-addr").when((kind == "ip") & F.col("value").contains(":"), "ipv6-addr").when(kind == "ip", "ipv4-addr")
    rows = report.withColumn("stix", stix).where(F.col("stix").isNotNull() & (F.col("details") != "private/reserved address"))
    key = F.concat(F.lit('{"value":'), json_string(F.col("value")), F.lit("}"))
    rows = rows.withColumn("sco", F.concat(F.col("stix"), F.lit("--"), uuid5(key)))
    quoted = F.replace(F.replace(F.col("value"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    pattern = F.concat(F.lit("["), F.col("stix"), F.lit(":value = '"), quoted, F.lit("']"))
    observable = F.struct(F.col("sco").alias("id"), F.col("stix").alias("type"), F.to_json(F.struct(F.col("stix").alias("type"), F.lit("2.1").alias("spec_version"), F.col("sco").alias("id"), F.col("value").alias("value"))).alias("object"))
    own = F.concat(F.lit("indicator--"), uuid5(F.concat(F.col("msg_id").cast("string"), F.lit(":"), pattern)))
    described = F.struct(
        F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), own.alias("id"), F.lit(at).alias("created"), F.lit(at).alias("modified"), F.concat(F.col("type"), F.lit(" "), F.col("indicator")).alias("name"),
        F.array(F.when(F.col("high"), "malicious-activity").otherwise("unknown")).alias("indicator_types"), pattern.alias("pattern"), F.lit("stix").alias("pattern_type"), F.lit(at).alias("valid_from"), F.array(F.lit("phishing")).alias("labels"),
    )
    indicator = F.struct(own.alias("id"), F.lit("indicator").alias("type"), F.to_json(described).alias("object"))
    return rows.select("msg_id", F.explode(F.array(observable, indicator)).alias("o")).select("msg_id", "o.*").dropDuplicates(["msg_id", "id"])


def misp_attributes(report: DataFrame) -> DataFrame:
    """(msg_id, type, category, value, to_ids): typed attributes; high risks are marked for detection."""
    kinds = {"url": "url", "domain": "domain", "ip": "ip-src", "email": "email-src", "filename": "filename", "sha256": "sha256", "md5": "md5"}
    kind = F.element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("type"))
    category = F.when(F.col("type").isin("filename", "sha256", "md5"), "Payload delivery").otherwise("Network activity")
    return report.select("msg_id", kind.alias("type"), category.alias("category"), "value", F.col("high").alias("to_ids"))


def stix_bundles(analyzed: DataFrame, objects: DataFrame, at: str) -> DataFrame:
    """(msg_id, bundle): one STIX 2.1 bundle for each message, with its objects (of stix_objects), the
    e-mail itself and a report that names them all. What is gathered is one message's."""
    h = F.col("headers")
    sender = F.when(h["from"]["email"].isNotNull(), F.concat(F.lit("email-addr--"), uuid5(F.concat(F.lit('{"value":'), json_string(h["from"]["email"]), F.lit("}")))))
    # Keys in order and no blanks: the canonical form that ids are made of.
    mail = F.to_json(F.struct(sender.alias("from_ref"), F.lit(False).alias("is_multipart"), h["subject"].alias("subject")))
    mail_id = F.concat(F.lit("email-message--"), uuid5(mail))
    message = F.to_json(F.struct(F.lit("email-message").alias("type"), F.lit("2.1").alias("spec_version"), mail_id.alias("id"), F.lit(False).alias("is_multipart"), sender.alias("from_ref"), h["subject"].alias("subject")))
    address = F.to_json(F.struct(F.lit("email-addr").alias("type"), F.lit("2.1").alias("spec_version"), sender.alias("id"), h["from"]["email"].alias("value")))
    own = F.array_compact(F.array(F.struct(mail_id.alias("id"), message.alias("object")), F.when(sender.isNotNull(), F.struct(sender.alias("id"), address.alias("object")))))
    rows = analyzed.select("msg_id", "tier", "score", h["subject"].alias("subject"), own.alias("own"))
    held = objects.groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("id", "object"))).alias("held")).withColumnRenamed("msg_id", "of_msg")
    rows = rows.join(held, rows["msg_id"] == held["of_msg"], "left")
    rows = rows.withColumn("held", F.coalesce("held", F.array().cast("array<struct<id:string,object:string>>")))
    ids = F.transform("held", lambda o: o["id"])
    every = F.concat("held", F.filter("own", lambda o: ~F.array_contains(ids, o["id"])))
    rows = rows.withColumn("every", every)
    name = F.concat(F.col("tier"), F.lit(" ("), F.col("score").cast("string"), F.lit("/100): "), F.coalesce("subject", F.lit("no subject")))
    key = F.col("msg_id").cast("string")
    report = F.to_json(F.struct(
        F.lit("report").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("report--"), uuid5(F.concat(F.lit("report:"), key))).alias("id"), F.lit(at).alias("created"), F.lit(at).alias("modified"),
        name.alias("name"), F.array(F.lit("threat-report")).alias("report_types"), F.lit(at).alias("published"), F.transform("every", lambda o: o["id"]).alias("object_refs"),
    ))
    body = F.array_join(F.concat(F.transform("every", lambda o: o["object"]), F.array(report)), ",")
    bundle = F.concat(F.lit('{"type":"bundle","id":"bundle--'), uuid5(F.concat(F.lit("bundle:"), key)), F.lit('","objects":['), body, F.lit("]}"))
    return rows.select("msg_id", bundle.alias("bundle"))


def misp_events(analyzed: DataFrame, attributes: DataFrame, day: str) -> DataFrame:
    """(msg_id, event): a MISP event for each message with its attributes (of misp_attributes); the
    threat level follows from the tier."""
    level = F.when(F.col("tier") == "High Risk", "1").when(F.col("tier") == "Suspicious", "2").when(F.col("tier") == "Low Risk", "3").otherwise("4")
    held = attributes.distinct().groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("type", "category", "value", "to_ids"))).alias("Attribute")).withColumnRenamed("msg_id", "of_msg")
    rows = analyzed.select("msg_id", level.alias("level"), F.col("headers.subject").alias("subject"), "tier")
    rows = rows.join(held, rows["msg_id"] == held["of_msg"], "left")
    event = F.struct(
        uuid5(F.concat(F.lit("event:"), F.col("msg_id").cast("string"))).alias("uuid"), F.lit(day).alias("date"), F.concat("tier", F.lit(": "), F.coalesce("subject", F.lit("no subject"))).alias("info"),
        F.col("level").alias("threat_level_id"), F.lit("2").alias("analysis"), F.lit("0").alias("distribution"), F.coalesce("Attribute", F.array().cast("array<struct<type:string,category:string,value:string,to_ids:boolean>>")).alias("Attribute"),
    )
    return rows.select("msg_id", F.to_json(F.struct(event.alias("Event"))).alias("event"))


def url_groups(analyzed: DataFrame) -> DataFrame:
    """(msg_id, url, destinations): each wrapped link of a message with the addresses behind it."""
    urls = F.array_distinct(F.transform("wrapped", lambda w: w["url"]))
    behind = F.transform(urls, lambda u: F.struct(u.alias("url"), F.array_distinct(F.transform(F.filter("wrapped", lambda w: w["url"] == u), lambda w: w["destination"])).alias("destinations")))
    return analyzed.select("msg_id", F.explode(behind).alias("g")).select("msg_id", "g.url", "g.destinations")
