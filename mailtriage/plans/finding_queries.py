"""Queries over forms of text and over findings, all derived from the corpus tables by their ids, so that
what an operator must find can be said again in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encoded, net
from ..operators import auth, highlight, identity, language, thread
from ..session import table
from ..sources import messages as M
from . import mail_queries, triage
from .intake_queries import PHRASES, pick, said, text_of

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _sql_pick(values, n: str = "doc_id") -> str:
    """SQL for the value that pick() takes."""
    listed = ["'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values]
    return f"list_extract([{', '.join(listed)}], ({n} % {len(listed)} + 1)::int)"


# --- forms of text --------------------------------------------------------------------------------

_MARKED = (
    'please <mark class="highlight-urgency" title="urgency">ACT\nimmediately</mark>: before the <mark class="highlight-urgency broad" title="urgency">deadlines</mark>.',
    'an <mark class="highlight-financial" title="financial">outstanding invoice</mark>, and another <mark class="highlight-financial broad" title="financial">invoice</mark>',
    'two <mark class="highlight-financial" title="financial">Outstanding-Invoices</mark>',
    '<mark class="highlight-credential" title="credential">VERIFY your mailbox passwords</mark>; <mark class="highlight-credential" title="credential">your mailbox</mark>: <mark class="highlight-social" title="social">tell nobody&#39;s</mark> friend',
    "nothing of the kind",
)


@query(f"""
    select doc_id as msg_id, sha256(replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') || chr(10)
        || {_sql_pick(_MARKED)}) as highlighted_sha256 from documents""")
def highlighted_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as escaped text with the phrases it says marked."""
    phrases = spark.createDataFrame(PHRASES, "category string, tier string, phrase string")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("msg_id"), said(F.col("doc_id"), F.col("text")).alias("text"))
    found = language.matches(texts, phrases).where(F.col("phrase").rlike("(?i)act|deadline|invoice|mailbox|nobody"))
    return highlight.highlighted_texts(texts, found).select("msg_id", F.sha2("highlighted", 256).alias("highlighted_sha256"))


@query("""
    select doc_id, case doc_id % 6 when 0 then 'hex' when 1 then 'hex' when 2 then 'base64' when 3 then 'data URI' end as kind, case when doc_id % 6 < 4 then sha256('x' || coalesce(text, '')) end as content_sha256,
        case doc_id % 6 when 4 then 'neither hex nor Base64' when 5 then 'an odd number of hex digits: ' || (2 * octet_length(encode('x' || coalesce(text, ''))) + 1) end as reason from documents""")
def encoded_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as hex, spaced hex, Base64 or a data URI, decoded again; damaged ones give a reason."""
    n = F.col("doc_id")
    content = F.encode(text_of("x", F.coalesce(F.col("text"), F.lit(""))), "UTF-8")
    digits, coded = F.hex(content), F.base64(content)
    spaced = F.regexp_replace(F.lower(digits), "(..)", "0x$1, ")
    given = F.when(n % 6 == 0, digits).when(n % 6 == 1, spaced).when(n % 6 == 2, coded).when(n % 6 == 3, text_of("data:text/plain;charset=utf-8;base64,", coded))
    given = given.when(n % 6 == 4, text_of(coded, "!")).otherwise(text_of(digits, "a"))
    rows = table(spark, sf_dir, "documents").select("doc_id", encoded.decoded(given).alias("d"))
    return rows.select("doc_id", "d.kind", F.sha2("d.content", 256).alias("content_sha256"), "d.reason")


_SUBJECTS = {"windows-1251": "Счёт", "koi8-r": "Привет", "iso-8859-2": "Zażółć", "windows-1253": "Λογαριασμός", "iso-8859-1": "Größe – 5 €"}


@query(f"select doc_id as msg_id, {_sql_pick(_SUBJECTS.values())} || ' ' || coalesce(source, '') as subject from documents")
def charset_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects in encoded words of five charsets."""
    n = F.col("doc_id")
    words = [f"=?{name}?Q?" + "".join(f"={b:02X}" for b in text.encode("cp1252" if name == "iso-8859-1" else name)) + "?=" for name, text in _SUBJECTS.items()]
    raw = text_of("From: <a@b.cd>\nSubject: ", pick(n, *words), " ", F.coalesce("source", F.lit("")), "\n\n")
    return M.parse_headers(table(spark, sf_dir, "documents").select(n.alias("msg_id"), raw.alias("raw"))).select("msg_id", F.col("headers.subject").alias("subject"))


_FORGED = {"ｐａｙｐａｌ": "paypal", "netﬂix": "netflix", "ⓐmazon": "amazon", "𝗴𝗶𝘁𝗵𝘂𝗯": "github", "micr0soft": "microsoft", "gооgle": "google"}


@query(f"select doc_id, {_sql_pick(_FORGED.values())} as brand, 'confusable' as kind from documents")
def forged_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that spell a brand in full-width, ligature, circled, mathematical, digit or Cyrillic forms."""
    n = F.col("doc_id")
    host = text_of("www", n, ".", pick(n, *_FORGED), ".com")
    found = table(spark, sf_dir, "documents").select("doc_id", net.lookalike(host).alias("l"))
    return found.select("doc_id", "l.brand", "l.kind")


# --- findings -------------------------------------------------------------------------------------


def _ids(found: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(found, lambda f: f["id"])), ",")


_SENDERS = (
    ('"Ann" <ann@example.com>', None, ""), ('"ceo@other.test" <x@evil.ru>', None, "display-name-address"), ("PayPal Support <x@evil.ru>", None, "display-name-brand"), ("<x@paypa1.com>", None, "lookalike-confusable"),
    ("<x@exampl.com>", None, "own-lookalike-typosquat"), ("<a@corp.test>", "<b@gmail.com>", "replyto-freemail"), ("<x@pаypal.com>", None, "lookalike-confusable,mixed-script"), ("<a@corp.test>", "<x@examp1e.com>", "own-lookalike-replyto"),
)


@query(f"select doc_id as msg_id, {_sql_pick([want for *_, want in _SENDERS])} as findings from documents")
def identity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found about senders of eight kinds, one of them honest."""
    n = F.col("doc_id")
    head = pick(n, *[f"From: {sender}\n" + (f"Reply-To: {reply}\n" if reply else "") for sender, reply, _ in _SENDERS])
    rows = M.parse_headers(table(spark, sf_dir, "documents").select(n.alias("msg_id"), text_of(head, "Subject: ", F.coalesce("source", F.lit("")), "\n\n").alias("raw")))
    return rows.select("msg_id", _ids(identity.identity_findings(F.col("headers"), ("example.com",))).alias("findings"))


_QUOTE = "Please pay today.\n\nFrom: Bob Ray <bob@client.example>\nSent: {day}, January {date}, 2024 3:10 PM\nTo: Ann Lee\nSubject: Invoice\n\nfine\n> On 15 Jan 2024, at 10:00, Ann Lee <ann@acme-corp.com> wrote:\n> hello\n"
_THREADS = (
    ("acme-corp", "Invoice", "", "Just a note.\n", ""), ("acrne-corp", "Re: Invoice", "", _QUOTE.format(day="Monday", date=16), "thread-bad-date,thread-fake-reply,thread-impersonation,thread-lookalike"),
    ("acme-corp", "Re: Invoice", "In-Reply-To: <1@client.example>\n", _QUOTE.format(day="Tuesday", date=16), ""), ("acme-corp", "Invoice", "", _QUOTE.format(day="Tuesday", date=16), "thread-pasted"),
    ("acme-corp", "Re: Invoice", "References: <1@client.example>\n", _QUOTE.format(day="Sunday", date=21), "thread-future-date"),
)


@query(f"select doc_id as msg_id, {_sql_pick([want for *_, want in _THREADS])} as findings from documents")
def thread_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found about quoted conversations: none, a fabricated, a genuine, a pasted one, one from the
    future."""
    n = F.col("doc_id")
    head = pick(n, *[f'From: "Ann Lee" <ann@{host}.com>\nSubject: {subject}\nDate: Wed, 17 Jan 2024 09:00:00 +0000\n{extra}\n' for host, subject, extra, *_ in _THREADS])
    rows = M.parse_headers(table(spark, sf_dir, "documents").select(n.alias("msg_id"), text_of(head, pick(n, *[body for *_, body, _ in _THREADS])).alias("raw")))
    rows = thread.with_thread(rows.withColumn("html", F.lit("")).withColumn("body_text", M.body_of(F.col("raw"))))
    h = F.col("headers")
    return rows.select("msg_id", _ids(thread.thread_findings(h, F.col("quoted"), F.col("separators"), auth.sent_at(h["date"]))).alias("findings"))


_ROUTES = (
    ("", "", ""), ("From: <b@example.com>\n", "2 from headers present", ""), ("", "SPF passed only by a lower, unproven result header", ""), ("ARC-Seal: i=1; cv=fail; d=x\n", "An ARC seal failed", ""),
    ("", "", "The Date header is more than a day away from delivery"), ("", "", "The message carries no Message-ID"), ("Received-SPF: fail (x) client-ip=203.0.113.9\n", "SPF headers disagree", ""), ("References: <x@example.com>\n", "", "Reply headers on a subject that is no reply"),
)


@query(f"select doc_id as msg_id, {_sql_pick([w for _, w, _ in _ROUTES])} as warnings, {_sql_pick([a for *_, a in _ROUTES])} as anomalies from documents")
def trust_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings and anomalies of messages whose headers were tampered with in one of seven ways, or not."""
    n = F.col("doc_id")
    k = n % 8
    forged = "Authentication-Results: mx.test; spf=fail smtp.mailfrom=a@example.com\nAuthentication-Results: forged.test; spf=pass smtp.mailfrom=a@example.com\n"
    results = F.when(k == 2, forged).otherwise("Authentication-Results: mx.test; spf=pass smtp.mailfrom=a@example.com; dkim=pass header.d=example.com; dmarc=pass\n")
    message_id = F.when(k == 5, "").otherwise(text_of("Message-ID: <", n, "@example.com>\n"))
    route = text_of("Received: from a.example.com (a.example.com [203.0.113.9]) by mx.test; Mon, 15 Jan 2024 10:00:05 +0000\nDate: ", F.when(k == 4, "Fri, 19").otherwise("Mon, 15"), " Jan 2024 10:00:00 +0000\n")
    raw = text_of(route, results, pick(n, *[extra for extra, *_ in _ROUTES]), "From: <a@example.com>\nSubject: report ", F.coalesce("source", F.lit("")), "\n", message_id, "\n")
    rows = auth.authenticate(M.parse_headers(table(spark, sf_dir, "documents").select(n.alias("msg_id"), raw.alias("raw"))))
    return rows.select("msg_id", F.array_join("trust.warnings", ",").alias("warnings"), F.array_join(F.transform("anomalies", lambda a: a["message"]), ",").alias("anomalies"))


@query("""
    with m as (select doc_id, case when doc_id % 4 = 0 then 'evil.ru' else 'example.com' end as host, list_extract(['fail', 'pass', 'softfail'], (doc_id % 3 + 1)::int) as spf, case when doc_id % 5 = 0 then 'none' else 'pass' end as dkim,
                      case when doc_id % 7 = 0 then 'fail' else 'pass' end as dmarc, doc_id % 2 = 0 as pays from documents),
         a as (select *, host = 'example.com' and (spf = 'pass' or dkim = 'pass') as aligned from m),
         p as (select *, greatest(0, 8 + case spf when 'fail' then 30 when 'softfail' then 18 else 0 end + case dkim when 'none' then 5 else 0 end + case dmarc when 'fail' then 35 else 0 end + case when aligned then 0 else 30 end
                         - case when aligned and spf = 'pass' and dkim = 'pass' and dmarc = 'pass' then 10 else 0 end) as auth, case when pays then 28 else 0 end as lang from a),
         s as (select *, greatest(floor(least(least(auth, 100) * 0.6 + 25 * 0.25 + lang * 0.15, 100) + 0.5), case when pays then 30 else 0 end)::int as score from p)
    select doc_id as msg_id, score, case when score >= 60 then 'High Risk' when score >= 30 then 'Suspicious' else 'Low Risk' end as tier,
        array_to_string(list_filter([case when pays then 'BEC / payment fraud' end, 'Malware delivery', case when dmarc = 'fail' or not aligned then 'Sender spoofing' end], lambda x: x is not null), ',') as attack_types from s""")
def mail_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, tier and attack types of messages with one link to a program, half of which press for a
    payment, by results of SPF, DKIM and DMARC."""
    n = F.col("msg_id")
    body = text_of("http://files.example.top/get.exe\n", F.when(n % 2 == 0, "We need a wire transfer. Keep this confidential.").otherwise("All is well."))
    rows = mail_queries.messages(spark, sf_dir)
    raw = text_of(F.substr(F.col("raw"), F.lit(1), M.head_end(F.col("raw"))), "\n\n", body)
    found = triage.analyze(rows.select("msg_id", raw.alias("raw")))
    return found.select("msg_id", "score", "tier", F.array_join("attack_types", ",").alias("attack_types"))
