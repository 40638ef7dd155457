"""Queries of the mail pipeline over messages that are built from the corpus tables.

The tables hold no messages, so each document becomes one: headers follow from its id, the body is
its text. What the pipeline must find is then known, and said again in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import auth, compare, correlate
from ..session import table
from ..sources import messages as M
from ..sources import mime
from . import triage

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, raw: a message for each document."""
    n = F.col("doc_id")
    host = F.when(n % 4 == 0, "evil.ru").otherwise("example.com")
    spf = F.element_at(F.array(*[F.lit(x) for x in ("fail", "pass", "softfail")]), (n % 3 + 1).cast("int"))
    dkim = F.when(n % 5 == 0, F.lit("none")).otherwise(F.concat(F.lit("pass header.d="), host))
    lines = [
        F.concat(F.lit("Return-Path: <bounce@"), host, F.lit(">")),
        F.concat(F.lit("Received: from "), host, F.lit(" ("), host, F.lit(" [203.0.113."), (n % 200 + 1).cast("string"), F.lit("]) by mx.test; Mon, 15 Jan 2024 10:00:05 +0000")),
        F.concat(F.lit("Authentication-Results: mx.test (checked; twice);\n spf="), spf, F.lit(" smtp.mailfrom=bounce@"), host, F.lit("; dkim="), dkim, F.lit("; dmarc="), F.when(n % 7 == 0, "fail").otherwise("pass")),
        F.concat(F.lit("From: \"Sender "), (n % 10).cast("string"), F.lit("\" <User"), (n % 10).cast("string"), F.lit("@Mail.Example.com>")),
        F.concat(F.lit("Subject: Re: report "), n.cast("string")), F.concat(F.lit("Message-ID: <"), n.cast("string"), F.lit("@example.com>")),
        F.lit("Content-Type: text/plain; charset=utf-8"), F.lit(""), F.concat(F.lit("http://"), F.col("source"), F.lit(".example.top/get.exe\n"), F.col("text")),
    ]
    return table(spark, sf_dir, "documents").select(n.alias("msg_id"), F.concat_ws("\n", *lines).alias("raw"))


@query("""
    with m as (select doc_id, case when doc_id % 4 = 0 then 'evil.ru' else 'example.com' end as host, list_extract(['fail', 'pass', 'softfail'], (doc_id % 3 + 1)::int) as spf,
                      case when doc_id % 5 = 0 then 'none' else 'pass' end as dkim, case when doc_id % 7 = 0 then 'fail' else 'pass' end as dmarc from documents)
    select doc_id as msg_id, 'user' || (doc_id % 10) || '@mail.example.com' as sender, 'Sender ' || (doc_id % 10) as name, spf, dkim, dmarc,
        host = 'example.com' and (spf = 'pass' or dkim = 'pass') as aligned, '203.0.113.' || (doc_id % 200 + 1) as ip from m""")
def mail_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and authentication of each message."""
    rows = auth.authenticate(M.parse_headers(messages(spark, sf_dir)))
    h = F.col("headers")
    return rows.select(
        "msg_id", h["from"]["email"].alias("sender"), h["from"]["name"].alias("name"), F.col("spf.status").alias("spf"), F.col("dkim.status").alias("dkim"),
        F.col("dmarc.status").alias("dmarc"), F.col("alignment.dmarc_aligned").alias("aligned"), F.col("sender_ip.public_ip").alias("ip"),
    )


@query("""
    select 'http://' || source || '.example.top/get.exe' as url, count(*) as n_messages, 'direct-download,risky-tld' as risks from documents group by 1""")
def mail_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of all messages with their risks, through the whole pipeline."""
    # explode() would get a filter below it that computes the indicators once more.
    found = triage.analyze(messages(spark, sf_dir)).select(F.explode_outer("iocs.urls").alias("u")).where("u is not null")
    rows = found.select(F.col("u.value").alias("url"), F.array_join(F.transform("u.risks", lambda r: r["type"]), ",").alias("risks"))
    return rows.groupBy("url", "risks").agg(F.count("*").alias("n_messages")).select("url", "n_messages", "risks")


@query("""
    with i as (select doc_id as msg, 'from' as type, 'user' || (doc_id % 10) || '@mail.example.com' as value from documents
               union all select doc_id, 'domain', 'mail.example.com' from documents union all select doc_id, 'domain', 'example.com' from documents
               union all select doc_id, 'displayName', 'sender ' || (doc_id % 10) from documents union all select doc_id, 'ip', '203.0.113.' || (doc_id % 200 + 1) from documents
               union all select doc_id, 'subject', 'report #' from documents union all select doc_id, 'messageIdDomain', 'example.com' from documents
               union all select doc_id, 'url', 'http://' || source || '.example.top/get.exe' from documents union all select doc_id, 'urlDomain', source || '.example.top' from documents)
    select type, value, count(*) as n_messages, min(msg) as first_seen from i group by 1, 2 having count(*) > 1""")
def mail_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators that messages share."""
    long = triage.message_indicators(triage.analyze(messages(spark, sf_dir)))
    return correlate.shared(long).select("type", "value", "n_messages", "first_seen")


@query("""
    with m as (select doc_id, case when doc_id % 4 = 0 then 'evil.ru' else 'example.com' end as host, list_extract(['fail', 'pass', 'softfail'], (doc_id % 3 + 1)::int) as spf,
                      case when doc_id % 5 = 0 then 'none' else 'pass' end as dkim, case when doc_id % 7 = 0 then 'fail' else 'pass' end as dmarc, source from documents),
         c as (select 'spf' as property, upper(spf) as value, case spf when 'pass' then 'good' when 'fail' then 'bad' else 'warn' end as tone, host from m
               union all select 'dkim', upper(dkim), case dkim when 'pass' then 'good' else 'muted' end, host from m
               union all select 'dmarc', upper(dmarc), case dmarc when 'pass' then 'good' else 'bad' end, host from m
               union all select 'alignment', case when host = 'example.com' and (spf = 'pass' or dkim = 'pass') then 'Aligned' else 'Not aligned' end,
                   case when host = 'example.com' and (spf = 'pass' or dkim = 'pass') then 'good' else 'bad' end, host from m
               union all select 'from', 'user' || (doc_id % 10) || '@mail.example.com', null, host from m
               union all select 'from_domain', 'mail.example.com', null, host from m
               union all select 'display_name', 'Sender ' || (doc_id % 10), null, host from m
               union all select 'reply_to', '—', null, host from m
               union all select 'return_path', 'bounce@' || host, null, host from m
               union all select 'sender_ip', '203.0.113.' || (doc_id % 200 + 1), null, host from m
               union all select 'message_id_domain', 'example.com', null, host from m
               union all select 'mailer', '—', null, host from m
               union all select 'link_count', '1', null, host from m
               union all select 'link_domains', source || '.example.top', null, host from m
               union all select 'deceptive_links', '0', 'muted', host from m
               union all select 'attachments', 'None', 'muted', host from m
               union all select 'hashes', '—', null, host from m
               union all select 'arc', 'None', null, host from m)
    select property, value, tone, count(*) as n_messages from c group by 1, 2, 3""")
def mail_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many messages have each value of a property. Properties that depend on the phrase table or
    on titles are left out, as SQL can't say them: tests/test_compare.py has them."""
    told = "spf dkim dmarc alignment from from_domain display_name reply_to return_path sender_ip message_id_domain mailer link_count link_domains deceptive_links attachments hashes arc".split()
    cells = compare.cells(triage.analyze(messages(spark, sf_dir)), told)
    return cells.groupBy("property", "value", "tone").agg(F.count("*").alias("n_messages"))


@query("""
    select doc_id::varchar as msg_id, null::varchar as parent_msg_id, 'outer' as subject from documents where doc_id % 10 = 0
    union all select doc_id || '/0', doc_id::varchar, 'Re: report ' || doc_id from documents where doc_id % 10 = 0
    union all select doc_id::varchar, null, 'Re: report ' || doc_id from documents where doc_id % 10 <> 0""")
def mail_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages, those attached to others included: every tenth one comes inside another."""
    inside = F.concat(F.lit('From: <a@b.test>\nSubject: outer\nContent-Type: multipart/mixed; boundary="==outer=="\n\n--==outer==\nContent-Type: message/rfc822\n\n'), F.col("raw"), F.lit("\n--==outer==--\n"))
    rows = messages(spark, sf_dir).withColumn("raw", F.when(F.col("msg_id") % 10 == 0, inside).otherwise(F.col("raw")))
    return M.parse_headers(mime.with_attached(rows)).select("msg_id", "parent_msg_id", F.col("headers.subject").alias("subject"))


@query("""
    select doc_id as msg_id, 'https://' || source || '.example.top/' || doc_id as url, case when doc_id % 3 = 2 then 'calendar link' else 'document link' end as kind,
        list_extract(['a.rtf', 'a.pdf', 'a.ics'], (doc_id % 3 + 1)::int) as within from documents""")
def mail_document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links inside attached documents: each message has a file of one of three formats."""
    n = F.col("doc_id")
    name = F.element_at(F.array(*[F.lit(x) for x in ("a.rtf", "a.pdf", "a.ics")]), (n % 3 + 1).cast("int"))
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.top/"), n.cast("string"))
    cut = F.length(url) - 3  # a calendar's lines are folded
    rtf, pdf = F.concat(F.lit('{\\rtf1 HYPERLINK "'), url, F.lit('"}')), F.concat(F.lit("%PDF-1.4\n<< /URI ("), url, F.lit(") >>"))
    folded = F.concat(F.lit("BEGIN:VCALENDAR\nURL:"), F.substr(url, F.lit(1), cut), F.lit("\n "), F.substr(url, cut + 1))
    head = F.concat(F.lit('From: <a@b.test>\nContent-Type: multipart/mixed; boundary="==p=="\n\n--==p==\nContent-Type: text/plain\n\n'), F.col("text"), F.lit('\n--==p==\nContent-Disposition: attachment; filename="'), name)
    raw = F.concat(head, F.lit('"\nContent-Type: application/octet-stream\n\n'), F.when(n % 3 == 0, rtf).when(n % 3 == 1, pdf).otherwise(folded), F.lit("\n--==p==--\n"))
    rows = table(spark, sf_dir, "documents").select(n.alias("msg_id"), raw.alias("raw"))
    return mime.parse_bodies(rows).select("msg_id", F.explode("destinations").alias("d")).select("msg_id", "d.url", "d.kind", "d.within")
