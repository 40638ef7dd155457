"""Queries over message files, phrases, addresses and lookup answers, all derived from the corpus tables
by their ids, so that what an operator must find can be said again in SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder, table
from ..sources import mailsource, mime
from ..sources import messages as M
from ..functions import net
from ..functions import refdata as R
from ..functions import text as T
from ..operators import auth, correlate, iocs, language, referrals, registration
from . import triage

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def pick(n: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def text_of(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- files ----------------------------------------------------------------------------------------


@query("""
    select 'm' || doc_id || case when doc_id % 3 = 0 then '.txt' else '.eml' end as name,
        case doc_id % 10 when 0 then null when 1 then null when 3 then 'headers' else 'full' end as kind,
        case doc_id % 10 when 0 then 'empty' when 1 then 'Outlook file' when 2 then 'no message header' end as reason,
        case when doc_id % 10 > 2 then 'report ' || doc_id end as subject,
        case doc_id % 10 when 0 then 2 when 1 then 8 end as size
    from documents""")
def mail_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message files written to a folder and read back, broken ones as rejects: of ten, one is empty,
    one is no text, one has no header and one has headers alone."""
    n = F.col("doc_id")
    whole = text_of("From: <a@example.com>\r\nSubject: report ", n, "\r\n")
    body = F.coalesce(F.col("text"), F.lit(""))
    content = F.when(n % 10 == 0, F.encode(F.lit("\r\n"), "UTF-8")).when(n % 10 == 1, F.unhex(F.lit("D0CF11E0A1B11AE1"))).when(n % 10 == 2, F.encode(text_of("a note\n\n", body), "UTF-8"))
    content = content.when(n % 10 == 3, F.encode(whole, "UTF-8")).otherwise(F.encode(text_of(whole, "\r\n", body), "UTF-8"))
    files = table(spark, sf_dir, "documents").select(text_of("m", n, F.when(n % 3 == 0, ".txt").otherwise(".eml")).alias("name"), content.alias("content"))
    folder = new_folder(spark, "mail-files")
    mailsource.write(files, folder)
    rows = M.with_raw(mailsource.read(spark, folder)).withColumn("msg_id", F.col("name"))
    rejects = triage.rejects(rows).withColumnRenamed("msg_id", "name")
    headed = M.parse_headers(rows.select("name", "raw", "size", "error"))
    read = headed.select("name", M.message_kind(F.col("raw")).alias("kind"), F.nullif(F.col("headers.subject"), F.lit("")).alias("subject"), F.when(F.col("error").isNotNull(), F.col("size").cast("int")).alias("size"))
    return read.join(rejects, "name", "left").select("name", "kind", "reason", "subject", "size")


# --- links ----------------------------------------------------------------------------------------


@query("""
    select doc_id as msg_id, doc_id % 4 in (1, 3) as deceptive from documents""")
def deceptive_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose text is an address: plain ones and ones that a gateway rewrote, half of them to
    another organisation's host."""
    n = F.col("doc_id")
    shown = text_of("https://bank.", F.col("source"), ".com/login")
    other = text_of("https://login-", F.col("source"), ".example.net/", n)
    target = F.when(n % 2 == 0, shown).otherwise(other)
    href = F.when(n % 4 < 2, target).otherwise(text_of("https://eur01.safelinks.protection.outlook.com/?url=", F.url_encode(target), "&amp;data=1"))
    page = text_of('<p>Dear customer</p><a href="', href, '">', shown, "</a>")
    raw = text_of("From: <a@example.com>\nSubject: sign in\nContent-Type: text/html; charset=utf-8\n\n", page)
    found = triage.analyze(table(spark, sf_dir, "documents").select(n.alias("msg_id"), raw.alias("raw")))
    return found.select("msg_id", F.exists("iocs.urls", lambda u: u["mismatch"]).alias("deceptive"))


# --- language -------------------------------------------------------------------------------------

PHRASES = (
    ("urgency", "strong", "act immediately"), ("urgency", "broad", "deadline"), ("financial", "strong", "outstanding invoice"), ("financial", "broad", "invoice"),
    ("credential", "strong", "verify your mailbox password"), ("credential", "strong", "your mailbox"), ("social", "strong", "tell nobody"),
)
_SAID = ("please ACT\nimmediately: before the deadlines.", "an outstanding invoice, and another invoice", "two Outstanding-Invoices", "VERIFY your mailbox passwords; your mailbox: tell nobody's friend", "nothing of the kind")


def phrase_table(spark: SparkSession) -> DataFrame:
    """PHRASES by way of Arrow: rows of Python's would go through Python workers, which stay in memory beside the pass over the texts."""
    return spark.createDataFrame(pa.table(list(zip(*PHRASES, strict=True)), ["category", "tier", "phrase"]))


def said(n: Column, text: Column) -> Column:
    return text_of(F.coalesce(text, F.lit("")), "\n", pick(n, *_SAID))


def _sql_said() -> str:
    return "coalesce(text, '') || chr(10) || list_extract([" + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in _SAID) + f"], (doc_id % {len(_SAID)} + 1)::int)"


def _sql_times(phrase: str) -> str:
    return "len(regexp_extract_all(t, '(?i)\\b" + "[\\W_]+".join(phrase.split()) + "(?:e?s)?\\b'))"


@query(f"""
    with t as (select doc_id, {_sql_said()} as t from documents),
         c as (select doc_id as msg_id, unnest([{{'category': 'urgency', 's': {_sql_times('act immediately')}, 'b': {_sql_times('deadline')}}},
                   {{'category': 'financial', 's': {_sql_times('outstanding invoice')}, 'b': {_sql_times('invoice')} - {_sql_times('outstanding invoice')}}},
                   {{'category': 'credential', 's': {_sql_times('your mailbox')}, 'b': 0}}, {{'category': 'social', 's': {_sql_times('tell nobody')}, 'b': 0}}], recursive := true) from t),
         w as (select * from (values {', '.join(f"('{c}', {w})" for c, w in R.CATEGORY_WEIGHTS.items())}) as w(category, weight))
    select msg_id, category, s as n_strong, b as n_broad, floor(least(s * weight * 10, 100) + 0.5)::bigint as score from c join w using (category) where s + b > 0""")
def phrase_table_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of a caller's table in documents that say them in other case, over line ends, with
    hyphens, as plurals, inside longer phrases: counts and score of each category."""
    phrases = phrase_table(spark)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("msg_id"), said(F.col("doc_id"), F.col("text")).alias("text"))
    known = F.col("category").isin([c for c, *_ in PHRASES])
    # Amounts and account numbers of the documents are patterns, not phrases.
    found = language.matches(texts, phrases).where(known & F.col("phrase").rlike("(?i)act|deadline|invoice|mailbox|nobody"))
    return language.category_scores(found).withColumn("score", F.col("score").cast("long"))


@query(f"""
    with t as (select doc_id, {_sql_said()} as t from documents),
         p as (select doc_id, lower(regexp_replace(unnest(regexp_extract_all(t, '(?i)\\boutstanding[\\W_]+invoices?\\b|\\binvoices?\\b')), '\\s+', ' ', 'g')) as phrase from t)
    select phrase, case when starts_with(phrase, 'out') then 'strong' else 'broad' end as tier, count(*) as n, count(distinct doc_id) as n_docs from p group by 1, 2""")
def phrase_wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wordings in which a category's phrases occur, over all documents."""
    phrases = phrase_table(spark)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("msg_id"), said(F.col("doc_id"), F.col("text")).alias("text"))
    found = language.matches(texts, phrases).where((F.col("category") == "financial") & F.col("phrase").rlike("(?i)invoice"))
    counted = language.phrase_counts(found)
    return counted.groupBy("phrase", "tier").agg(F.sum("n").alias("n"), F.countDistinct("msg_id").alias("n_docs"))


def _sql_share(marks: list[str]) -> str:
    return "len(list_filter(w, lambda x: list_contains([" + ", ".join(f"'{m}'" for m in marks) + "], x))) / len(w)"


@query(f"""
    with w as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^0-9a-z_]+'), lambda x: x <> '') as w from documents),
         s as (select doc_id, len(w) as n, unnest([{', '.join(f"{{'o': {i}, 'name': '{name}', 'least': {least}, 'share': {_sql_share(marks)}}}" for i, (name, least, marks) in enumerate(R.LANGUAGE_MARKERS))}], recursive := true) from w),
         b as (select doc_id, arg_max(name, (share, -o)) as name from s where n >= 10 and share > least group by 1)
    select coalesce(name, 'unknown') as detected, coalesce(lang, '') as lang, count(*) as n from documents left join b using (doc_id) group by 1, 2""")
def language_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that marker words decide for each document, against its label."""
    rows = table(spark, sf_dir, "documents").select(language.detected(F.col("text")).alias("detected"), F.coalesce("lang", F.lit("")).alias("lang"))
    return rows.groupBy("detected", "lang").agg(F.count("*").alias("n"))


# --- addresses and headers ------------------------------------------------------------------------


@query("""
    with s as (select doc_id, 0 as rank, 'X-Originating-IP' as source, 4 as kind from documents where doc_id % 3 = 0 union all select doc_id, 1, 'Received', 4 from documents
               union all select doc_id, 1, 'Received', 6 from documents union all select doc_id, 2, 'Body', 6 from documents union all select doc_id, 2, 'Body', 4 from documents where doc_id % 2 = 0)
    select doc_id as msg_id, case kind when 4 then '198.51.100.' || (doc_id % 200) else '2001:0db8:0000:0000:0000:0000:' || lpad(lower(to_hex(doc_id // 65536 % 65536)), 4, '0') || ':' || lpad(lower(to_hex(doc_id % 65536)), 4, '0') end as address,
        arg_min(source, rank) as source, array_to_string(list_sort(list(source)), ',') as sources from s group by doc_id, kind""")
def ip_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of messages with the best of their sources and all of them: one address of each kind,
    spelled in other ways in the body, where the document's own addresses are taken out."""
    n = F.col("doc_id")
    tail = F.lower(F.hex(n % 65536))
    high = F.lower(F.hex(F.floor(n / 65536) % 65536))
    four, six = text_of("198.51.100.", n % 200), text_of("2001:DB8:0::", high, ":", tail)
    long = text_of("2001:0db8:0000:0000:0000:0000:", F.lpad(high, 4, "0"), ":", F.lpad(tail, 4, "0"))
    route = text_of("Received: from a.example.com (a.example.com [", four, "] [IPv6:", six, "]) by mx.test; Mon, 15 Jan 2024 10:00:05 +0000\n")
    given = F.when(n % 3 == 0, text_of("X-Originating-IP: [", four, "]\n")).otherwise("")
    prose = F.translate(F.coalesce(F.col("text"), F.lit("")), ".:", "  ")
    body = text_of(prose, "\nsee [", long, "]", F.when(n % 2 == 0, text_of(", once ::ffff:", four)).otherwise(""))
    rows = table(spark, sf_dir, "documents").select(n.alias("msg_id"), text_of("From: <a@b.cd>\n", given, route, "\n", body).alias("raw"))
    rows = auth.authenticate(M.parse_headers(rows))
    mentions = rows.select("msg_id", F.explode(iocs.ip_mentions(F.col("headers"), F.col("route"), M.body_of(F.col("raw")))).alias("m"))
    mentions = mentions.select("msg_id", net.ip_full(net.ip_value(F.col("m.value"))).alias("address"), "m.source", "m.rank", "m.place")
    found = correlate.with_precedence(mentions, ["msg_id", "address"])
    return found.select("msg_id", "address", "source", F.array_join("sources", ",").alias("sources"))


@query("""
    select doc_id as msg_id, ['mx.test', 'mx2.test'][(doc_id % 2 + 1)::int] as server, ['pass', 'fail', 'softfail'][(doc_id % 3 + 1)::int] as spf, 'pass' as dkim, 'a;b;c ' || source as reason, 3 as n from documents""")
def nested_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authentication-Results with comments nested fifty deep and quoted strings full of semicolons."""
    n = F.col("doc_id")
    deep = "(" * 50 + "; spf=none" + ")" * 50
    value = text_of(pick(n, "mx.test", "mx2.test"), " ", deep, "; spf=", pick(n, "pass", "fail", "softfail"), ' reason="a;b;c ', F.col("source"), '"; dkim=pass (', F.col("source"), "; (dkim=fail)); dmarc=none")
    found = table(spark, sf_dir, "documents").select(n.alias("msg_id"), "source", value.alias("v")).withColumn("c", auth.clauses(F.col("v")))

    def result(method: str) -> Column:
        return auth.of_method(F.col("c"), method)[0]["result"]

    return found.select("msg_id", auth.authserv(F.col("v")).alias("server"), result("spf").alias("spf"), F.coalesce(result("dkim"), F.lit("none")).alias("dkim"), auth.prop(auth.of_method(F.col("c"), "spf")[0], "reason").alias("reason"), F.size("c").alias("n"))


_DEFANG = r"(?i)\b(?:https?|ftp)://[^\s<>\"'`)\]]+|[a-z0-9._%+-]+@(?:[a-z0-9-]+\.)+[a-z]{2,}|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b|\b(?:[a-z0-9-]+\.)+[a-z]{2,}\b".replace("'", "''")


@query(f"""
    with t as (select doc_id, coalesce(text, '') || chr(10) || 'see HTTP://' || coalesce(source, '') || '.example.com:8080/a?b=1, Invoice' || doc_id || '.pdf, ' || coalesce(source, '') || '@mail.example.com, 203.0.113.' || (doc_id % 200) || ' header.from' as t from documents),
         p as (select doc_id, t, regexp_split_to_array(t, '{_DEFANG}') as between, regexp_extract_all(t, '{_DEFANG}') as found from t),
         d as (select doc_id, t, found, between, list_transform(found, lambda m: case
                    when contains(m, '://') then regexp_replace(regexp_replace(lower(split_part(m, '://', 1)), '^http', 'hxxp'), '^ftp', 'fxp') || '[://]' || replace(m[length(split_part(m, '://', 1)) + 4:], '.', '[.]')
                    when contains(m, '@') then replace(regexp_extract(m, '^(.*)@', 1), '', '') || '[@]' || replace(split_part(m, '@', -1), '.', '[.]')
                    when list_contains([{', '.join(f"'{e}'" for e in T.FILE_ENDINGS)}], lower(split_part(m, '.', -1))) or regexp_matches(lower(m), '^(header|smtp|policy|body)[.][a-z-]+$') then m
                    else replace(m, '.', '[.]') end) as safe from p)
    select doc_id, len(found) as n_found, sha256(array_to_string(list_transform(range(1, len(between) + 1), lambda i: between[i] || coalesce(safe[i], '')), '')) as safe_sha256 from d""")
def defanged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with a line of links, files and addresses, defanged in one pass."""
    n, source = F.col("doc_id"), F.coalesce("source", F.lit(""))
    said = text_of(F.coalesce(F.col("text"), F.lit("")), "\nsee HTTP://", source, ".example.com:8080/a?b=1, Invoice", n, ".pdf, ", source, "@mail.example.com, 203.0.113.", n % 200, " header.from")
    rows = table(spark, sf_dir, "documents").select("doc_id", said.alias("t"))
    return rows.select("doc_id", T.defanged(F.col("t")).alias("d")).select("doc_id", F.col("d.n").cast("long").alias("n_found"), F.sha2("d.text", 256).alias("safe_sha256"))


# --- registration ---------------------------------------------------------------------------------

_BOOTSTRAP = (
    '{"services":[[["top","test"],["https://rdap.one/"]],[["co.top","example.test"],["https://rdap.two"]],[["zz"],[]]]}',
    '{"services":[[["203.0.0.0/8"],["https://ip.one/"]],[["203.0.113.0/24"],["https://ip.two/","http://ip.two/"]],[["2001:db8::/32"],["https://ip.six"]]]}',
)


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    value = F.when(n % 5 == 0, text_of("Host", n % 50, ".", F.coalesce("source", F.lit("x")), ".co.TOP")).when(n % 5 == 1, text_of("h", n % 50, ".example.test")).when(n % 5 == 2, text_of("203.0.", F.when(n % 2 == 0, 113).otherwise(7), ".", n % 200))
    value = value.when(n % 5 == 3, text_of("2001:DB8:0::", F.hex(n % 1000))).otherwise(text_of("d", n % 50, ".zz"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when((n % 5).isin(2, 3), "ip").otherwise("domain").alias("kind"), value.alias("value"))


@query("""
    with t as (select distinct doc_id % 5 as k, case doc_id % 5 when 0 then 'host' || (doc_id % 50) || '.' || coalesce(source, 'x') || '.co.top' when 1 then 'h' || (doc_id % 50) || '.example.test'
                   when 2 then '203.0.' || (case when doc_id % 2 = 0 then 113 else 7 end) || '.' || (doc_id % 200) when 3 then '2001:db8:0::' || lower(to_hex(doc_id % 1000)) else 'd' || (doc_id % 50) || '.zz' end as value from documents)
    select case when k in (2, 3) then 'ip' else 'domain' end as kind, value,
        case when k in (0, 1) then 'https://rdap.two' when k = 2 then case when starts_with(value, '203.0.113.') then 'https://ip.two' else 'https://ip.one' end when k = 3 then 'https://ip.six' end as server,
        case when k = 0 then 'co.top' when k = 1 then 'example.test' when k = 2 then case when starts_with(value, '203.0.113.') then '120' else '104' end when k = 3 then '32' end as matched
    from t""")
def registry_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The server that answers for each domain and address: longest listed suffix or prefix."""
    listed = registration.services(spark.createDataFrame([(b,) for b in _BOOTSTRAP], "body string"))
    return registration.server_of(_targets(spark, sf_dir), listed)


@query("""
    select doc_id, 'host' || doc_id || '.test' as target, case when doc_id % 4 = 1 then 'Org ' || doc_id else 'Registrar ' || (doc_id % 7) end as registrar,
        case when doc_id % 3 = 0 then 'Holder "' || coalesce(source, '') || '"' else 'Person ' || doc_id end as registrant, case when doc_id % 2 = 0 then 'DE' end as country,
        '2024-01-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') || 'T00:00:00Z' as registered, case when doc_id % 2 = 0 then '2024-02-01' else '2024-03-01' end as updated, 'abuse' || doc_id || '@test' as abuse_email, 'ns1.test,ns2.test' as nameservers, case when doc_id % 6 = 0 then 0 else 2 end as n_statuses
    from documents where doc_id % 10 <> 9 union all select doc_id, null, null, null, null, null, null, null, null, null from documents where doc_id % 10 = 9""")
def registration_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration answers as a registry would give them, read into columns; each tenth one failed."""
    n = F.col("doc_id")

    def card(*fields: str | Column) -> Column:
        return text_of('["vcard",[["version",{},"text","4.0"]', *fields, "]]")

    def text(name: str, value: Column) -> Column:
        return text_of(f',["{name}",{{}},"text","', F.replace(value, F.lit('"'), F.lit('\\"')), '"]')

    address = text_of(',["adr",{},"text",["","","Street ', n, '","City","","1","DE"]]')
    holder = F.when(n % 3 == 0, text("org", text_of('Holder "', F.coalesce("source", F.lit("")), '"'))).otherwise(text("fn", text_of("Person ", n)))
    registrar = F.when(n % 4 == 1, text("org", text_of("Org ", n))).otherwise(text("fn", text_of("Registrar ", n % 7)))
    inner = F.when(n % 2 == 0, text_of(',"entities":[{"roles":["abuse"],"vcardArray":', card(text("email", text_of("abuse", n, "@test"))), "}]")).otherwise("")
    outer = F.when(n % 2 == 1, text_of(',{"roles":["technical","abuse"],"vcardArray":', card(text("email", text_of("abuse", n, "@test"))), "}")).otherwise("")
    body = text_of(
        '{"objectClassName":"domain","ldhName":"host', n, '.test","status":', F.when(n % 6 == 0, "null").otherwise('["active","locked"]'), ',"events":[{"eventAction":"registration","eventDate":"2024-01-', F.lpad((n % 28 + 1).cast("string"), 2, "0"), 'T00:00:00Z"},',
        F.when(n % 2 == 0, '{"eventAction":"last changed","eventDate":"2024-02-01"},').otherwise(""), '{"eventAction":"last update of RDAP database","eventDate":"2024-03-01"}],"nameservers":[{"ldhName":"ns1.test"},{},{"ldhName":"ns2.test"}],"entities":[{"roles":["registrant"],"vcardArray":',
        card(F.when(n % 2 == 0, address).otherwise(""), holder), '},{"roles":["registrar"],"vcardArray":', card(registrar), inner, "}", outer, "]}",
    )
    answers = table(spark, sf_dir, "documents").select("doc_id", F.lit("domain").alias("kind"), text_of("host", n, ".test").alias("value"), (n % 10 != 9).alias("ok"), body.alias("body"))
    r = F.col("registration")
    found = registration.registrations(answers)
    joined = F.when(F.size(r["nameservers"]) > 0, F.array_join(r["nameservers"], ","))
    columns = [r[k].alias(k) for k in ("target", "registrar", "registrant", "country", "registered", "updated", "abuse_email")]
    return found.select("doc_id", *columns, joined.alias("nameservers"), F.when(r.isNotNull(), F.size(r["statuses"])).alias("n_statuses"))


@query("""
    with t as (select distinct doc_id % 6 as k, 'd' || doc_id || '.t' || (doc_id % 6) as value, doc_id from documents)
    select value, case k when 0 then 'whois.iana.org' when 1 then 'whois.iana.org,whois.t1' when 2 then 'whois.iana.org,whois.t2,whois.registrar' when 3 then 'whois.iana.org,whois.t3,whois.loop' when 4 then 'whois.iana.org,whois.t4' end as servers,
        case k when 3 then 'cycle' when 4 then 'missing' when 5 then 'missing' else 'answer' end as ended, case when k = 5 then null else k = 1 end as not_found,
        case k when 2 then 'Registrar ' || doc_id when 3 then 'Looped' when 4 then 'Thin' end as registrar, case when k = 2 then 'ns.' || value end as nameservers
    from t""")
def whois_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referral chains over a table of answers: none, one that ends in `not found`, a chain of three, a
    cycle, a server without an answer, and a root without one."""
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of("d", n, ".t", n % 6).alias("value"), (n % 6).alias("k"))
    root = spark.createDataFrame([("t0", "domain: T0\n"), ("t1", "refer:  whois.t1\n"), ("t2", "% hello\nwhois: WHOIS.t2"), ("t3", "refer: whois.t3"), ("t4", "refer: whois.t4")], "query string, text string").select(F.lit("whois.iana.org").alias("server"), "query", "text")
    first = F.when(F.col("k") == 1, text_of("No match for ", F.col("value"))).when(F.col("k") == 2, text_of("Domain Name: ", F.col("value"), "\r\nRegistrar WHOIS Server: whois://whois.registrar:43/\r\nRegistrar: Thin\r\n"))
    first = first.when(F.col("k") == 3, "Registrar WHOIS Server: whois.loop").when(F.col("k") == 4, "Registrar: Thin\nRegistrar WHOIS Server: whois.gone")
    second = F.when(F.col("k") == 2, text_of("Registrar: Registrar ", n, "\nName Server: NS.", F.col("value"), "\n")).when(F.col("k") == 3, "Registrar: Looped\nwhois: whois.t3")
    by_registry = docs.select(text_of("whois.t", F.col("k")).alias("server"), F.col("value").alias("query"), first.alias("text"))
    by_registrar = docs.select(F.when(F.col("k") == 2, "whois.registrar").otherwise("whois.loop").alias("server"), F.col("value").alias("query"), second.alias("text"))
    found = referrals.follow(docs, root.unionByName(by_registry).unionByName(by_registrar))
    found = found.withColumn("s", F.when(F.col("text").isNotNull(), referrals.summary(F.col("text"))))
    return found.select("value", F.nullif(F.array_join("servers", ","), F.lit("")).alias("servers"), "ended", F.col("s.not_found").alias("not_found"), F.col("s.registrar").alias("registrar"), F.nullif(F.array_join("s.nameservers", ","), F.lit("")).alias("nameservers"))
