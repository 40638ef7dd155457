"""Queries that apply the library's operators to the corpus tables, each with its DuckDB SQL.

All of them are declarative: filters and columns reach the Parquet scan, and the only shuffles are
those of the aggregations, joins and windows that the operators themselves ask for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import net, refdata, text
from ..session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_EMAIL = net.EMAIL
_IPV4 = net.IPV4
_HOST = r"regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"


def _org(domain: str) -> str:
    p = f"list_filter(string_split(regexp_replace(lower({domain}), '\\.$', ''), '.'), lambda x: x <> '')"
    two, three = f"array_to_string(list_slice({p}, -2, -1), '.')", f"array_to_string(list_slice({p}, -3, -1), '.')"
    return f"(case when len({p}) <= 2 then nullif(array_to_string({p}, '.'), '') when list_contains({_list(refdata.TWO_LABEL_SUFFIXES)}, {two}) then {three} else {two} end)"


def _skeleton(value: str) -> str:
    return f"regexp_replace(replace(replace(translate(lower({value}), '{refdata.CONFUSABLE_FROM}', '{refdata.CONFUSABLE_TO}'), 'rn', 'm'), 'vv', 'w'), '[^a-z0-9]', '', 'g')"


_STRIPPED = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'),
    '&nbsp;', ' '), '&#39;', ''''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '\\s+', ' ', 'g'))"""


# --- indicators -----------------------------------------------------------------------------------


@query(f"""
    with e as (select doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) as raw, generate_subscripts(regexp_extract_all(text, '{_EMAIL}'), 1) as ord from documents)
    select doc_id, lower(raw) as email, min(ord) as ord from e group by doc_id, lower(raw)""")
def ioc_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail indicators of each document; of equal ones the first stays."""
    found = table(spark, sf_dir, "documents").where(F.col("text").contains("@"))
    found = found.select("doc_id", F.posexplode(net.find_emails(F.col("text"))).alias("pos", "email"))
    return found.groupBy("doc_id", "email").agg((F.min("pos") + 1).cast("long").alias("ord"))


@query(f"""
    with e as (select distinct doc_id, lower(unnest(regexp_extract_all(text, '{_EMAIL}'))) as email from documents)
    select split_part(email, '@', -1) as domain, count(*) as n_emails, count(distinct doc_id) as n_docs from e group by 1""")
def ioc_email_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    emails = ioc_emails(spark, sf_dir).select("doc_id", net.domain_part(F.col("email")).alias("domain"))
    return emails.groupBy("domain").agg(F.count("*").alias("n_emails"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"""
    with r as (select doc_id, unnest(regexp_extract_all(text, '[0-9.]+')) as ip from documents)
    select distinct doc_id, ip from r where regexp_full_match(ip, '{_IPV4[1:-1]}')""")
def ioc_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(net.find_ipv4(F.col("text"))).alias("ip"))


@query(f"""
    with r as (select unnest(regexp_extract_all(text, '[0-9.]+')) as ip from documents),
         v as (select ip, count(*) as n, list_transform(string_split(ip, '.'), lambda x: x::int) as o from r where regexp_full_match(ip, '{_IPV4[1:-1]}') group by ip)
    select ip, o[1] in (0, 10, 127) or o[1] >= 224 or (o[1] = 172 and o[2] between 16 and 31) or (o[1] = 192 and o[2] = 168) or (o[1] = 169 and o[2] = 254)
        or (o[1] = 100 and o[2] between 64 and 127) as is_private from v""")
def ip_private_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ioc_ipv4(spark, sf_dir).select("ip").distinct().select("ip", net.private_ipv4(F.col("ip")).alias("is_private"))


@query(f"select page_id, nullif({_HOST}, '') as host, {_org(_HOST)} as org from pages")
def url_host_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = net.url_host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), net.org_domain(host).alias("org"))


@query(f"""
    select {_org(_HOST)} as org, count(*) as n_pages, count(distinct {_HOST}) as n_hosts, min(page_id) as first_page
    from pages group by 1""")
def org_domain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url_host_org(spark, sf_dir)
    return rows.groupBy("org").agg(F.count("*").alias("n_pages"), F.countDistinct("host").alias("n_hosts"), F.min("page_id").alias("first_page"))


@query(f"""
    select page_id, list_contains({_list(refdata.RISKY_TLDS)}, split_part({_HOST}, '.', -1)) as risky_tld,
        list_contains({_list(refdata.SHORTENERS)}, {_HOST}) or len(list_filter({_list(refdata.SHORTENERS)}, lambda s: ends_with({_HOST}, '.' || s))) > 0 as shortener,
        contains({_HOST}, 'xn--') as punycode, regexp_full_match({_HOST}, '{_IPV4[1:-1]}') as ip_host
    from pages""")
def url_risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.coalesce(net.url_host(F.col("url")), F.lit(""))
    return table(spark, sf_dir, "pages").select(
        "page_id", net.risky_tld(host).alias("risky_tld"), net.under_domain(host, refdata.SHORTENERS).alias("shortener"),
        host.contains("xn--").alias("punycode"), net.valid_ipv4(host).alias("ip_host"),
    )


@query("select page_id, replace(regexp_replace(url, '(?i)http', 'hxxp', 'g'), '.', '[.]') as defanged from pages")
def defang_url_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.defang_light(F.col("url")).alias("defanged"))


@query(r"""
    select page_id, regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)(.*)$', 1), '(?i)http', 'hxxp', 'g') || '[://]'
        || replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)(.*)$', 2), '.', '[.]') || regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)(.*)$', 3) as defanged
    from pages where regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://')""")
def defang_url_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where(F.col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"))
    return pages.select("page_id", text.defang_url(F.col("url")).alias("defanged"))


@query(f"""
    with e as (select distinct lower(unnest(regexp_extract_all(text, '{_EMAIL}'))) as email from documents)
    select email, regexp_extract(email, '^(.*)@([^@]*)$', 1) || '[@]' || replace(regexp_extract(email, '^(.*)@([^@]*)$', 2), '.', '[.]') as defanged from e""")
def defang_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ioc_emails(spark, sf_dir).select("email").distinct().select("email", text.defang_email(F.col("email")).alias("defanged"))


# --- HTML -----------------------------------------------------------------------------------------


@query(r"""
    with a as (select page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)) as href,
                      generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']+)["''][^>]*>(.*?)</a>', 1), 1) as ord from pages)
    select page_id, ord, trim(href) as href from a""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", F.posexplode(text.html_links(F.col("html"))).alias("pos", "link"))
    return links.select("page_id", (F.col("pos") + 1).cast("long").alias("ord"), F.col("link.href").alias("href"))


@query(f"select page_id, md5({_STRIPPED}) as text_md5, length({_STRIPPED}) as n_chars from pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("t"))
    return stripped.select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


@query(r"""
    select page_id, len(regexp_extract_all(html, '(?i)<script')) as n_scripts, len(regexp_extract_all(html, '(?i)<form')) as n_forms,
        regexp_matches(html, '(?i)<input\b[^>]*type\s*=\s*["'']?password') as password_form,
        regexp_matches(html, '(?i)<(?:!doctype html|html|head|body|script|form|iframe|meta|div|table|a\s)') as is_html
    from pages""")
def html_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_count(html, F.lit("(?i)<script")).cast("long").alias("n_scripts"), F.regexp_count(html, F.lit("(?i)<form")).cast("long").alias("n_forms"),
        html.rlike(r"""(?i)<input\b[^>]*type\s*=\s*["']?password""").alias("password_form"), text.looks_like_html(html).alias("is_html"),
    )


@query("select page_id, count(*) as n_distinct from (select distinct page_id, unnest(regexp_extract_all(html, '(?is)<([a-z][a-z0-9]*)', 1)) as tag from pages) group by page_id")
def html_tag_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array_distinct(F.regexp_extract_all("html", F.lit("(?is)<([a-z][a-z0-9]*)"), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", F.size(tags).cast("long").alias("n_distinct")).where("n_distinct > 0")


# --- hashes and files -----------------------------------------------------------------------------


@query("select doc_id, sha256(text) as sha256, md5(text) as md5, sha1(text) as sha1, strlen(text) as n_bytes from documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("sha256"), F.md5(t).alias("md5"), F.sha1(t).alias("sha1"), F.octet_length(t).cast("long").alias("n_bytes"))


@query("""
    select doc_id, lang || '.' || case doc_id % 5 when 0 then 'pdf.exe' when 1 then 'TXT' when 2 then 'js' when 3 then 'zip' else '' end as name,
        case doc_id % 5 when 0 then 'exe' when 1 then 'txt' when 2 then 'js' when 3 then 'zip' else '' end as ext,
        doc_id % 5 in (0, 2) as risky, doc_id % 5 = 0 as double_ext
    from documents""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = F.element_at(F.array(*[F.lit(x) for x in ("pdf.exe", "TXT", "js", "zip", "")]), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(".", "lang", endings).alias("name"))
    return rows.select("doc_id", "name", text.extension_of(F.col("name")).alias("ext"), text.risky_extension(F.col("name")).alias("risky"), text.double_extension(F.col("name")).alias("double_ext"))


@query("""
    select page_id, case when starts_with(hex(encode(html)), '3C21') then 'markup' when starts_with(hex(encode(html)), '3C') then 'tag' else 'text' end as head,
        cast(null as varchar) as sniffed
    from pages""")
def sniff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode(F.col("html"), "UTF-8")
    start = F.hex(F.substring(content, 1, 2))
    head = F.when(start == "3C21", "markup").when(F.startswith(start, F.lit("3C")), "tag").otherwise("text")
    return table(spark, sf_dir, "pages").select("page_id", head.alias("head"), text.sniffed(content).alias("sniffed"))


_HEADS = [(kind, code) for kind, code, _ in text.FILE_TYPES if kind not in text.OFFSETS]


@query(f"""
    select doc_id, list_extract({_list([k for k, _ in _HEADS] + [""])}, (doc_id % {len(_HEADS) + 1} + 1)::int) as sniffed,
        list_contains({_list([k for k, _, e in text.FILE_TYPES if "exe" in e.split()])}, list_extract({_list([k for k, _ in _HEADS] + [""])}, (doc_id % {len(_HEADS) + 1} + 1)::int)) or doc_id % {len(_HEADS) + 1} = {len(_HEADS)} as fits
    from documents""")
def sniffed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind the first bytes of each file type, named as programs: the type that the bytes
    tell, and whether the name fits. One in so many has no such bytes."""
    n = (F.col("doc_id") % (len(_HEADS) + 1)).cast("int")
    head = F.element_at(F.array(*[F.lit(code) for _, code in _HEADS], F.lit("2D2D")), n + 1)
    content = F.concat(F.unhex(head), F.encode(F.concat(F.lit("-"), F.coalesce("text", F.lit(""))), "UTF-8"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.sniffed(content).alias("kind"))
    return rows.select("doc_id", F.coalesce("kind", F.lit("")).alias("sniffed"), text.belongs(F.col("kind"), F.lit("exe")).alias("fits"))


# --- correlation ----------------------------------------------------------------------------------


@query("""
    with h as (select doc_id, sha256(text) as value from documents),
         s as (select value, count(*) as n_messages, min(doc_id) as first_seen from h where value is not null group by 1 having count(*) > 1)
    select value, n_messages, first_seen, doc_id as msg from s join h using (value)""")
def content_hash_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared indicators of type hash, a row for each member."""
    from ..operators import correlate

    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    long = correlate.indicators(rows, "doc_id", {"hash": F.col("hash")})
    return correlate.members(long, correlate.shared(long)).select("value", "n_messages", "first_seen", "msg")


_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '^\s*(re|fw|fwd)\s*:\s*', ''), '[0-9]+', '#', 'g'), '\s+', ' ', 'g'))"


@query(f"""
    select {_KEY} as subject, count(distinct doc_id) as n_messages, min(doc_id) as first_seen, 30 as weight
    from documents where {_KEY} <> '' group by 1 having count(distinct doc_id) > 1""")
def shared_subject_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject patterns (first lines) seen in more than one document."""
    key = text.subject_key(F.substring_index("text", "\n", 1))
    rows = table(spark, sf_dir, "documents").select("doc_id", key.alias("subject")).where("subject <> ''").dropDuplicates(["doc_id", "subject"])
    shared = rows.groupBy("subject").agg(F.count("*").alias("n_messages"), F.min("doc_id").alias("first_seen"))
    return shared.where("n_messages > 1").withColumn("weight", F.lit(refdata.INDICATOR_WEIGHTS["subject"]))


@query(f"""
    with i as (select page_id as msg, 'urlDomain' as type, {_HOST} as value, 70 as weight from pages
               union all select page_id, 'domain', {_org(_HOST)}, 55 from pages
               union all select page_id, 'url', lower(url), 80 from pages)
    select type, value, weight, count(distinct msg) as n_messages, min(msg) as first_seen from i where value <> '' group by 1, 2, 3 having count(distinct msg) > 1""")
def shared_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of pages that more than one page has, strongest first."""
    from ..operators import correlate

    host = net.url_host(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.lower("url").alias("url"), host.alias("host"), net.org_domain(host).alias("org"))
    long = correlate.indicators(rows, "page_id", {"urlDomain": F.col("host"), "domain": F.col("org"), "url": F.col("url")})
    return correlate.shared(long).select("type", "value", "weight", "n_messages", "first_seen")


@query("""
    with c as (select 'lang' as property, doc_id as msg, lang as value from documents
               union all select 'source', doc_id, source from documents
               union all select 'table', doc_id, 'documents' from documents)
    select property, count(*) as n_cells, count(distinct value) as n_values, count(distinct value) = 1 and count(*) > 1 as identical from c group by property""")
def compare_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a comparison: properties by message, and whether all messages agree."""
    from ..operators import correlate

    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.lit("documents").alias("table"))
    cells = correlate.cells(rows, "doc_id", ["lang", "source", "table"])
    return correlate.agreement(cells).select("property", "n_cells", "n_values", "identical")


@query("""
    select source, sum(case when lang = 'de' then 1 else 0 end)::bigint as de, sum(case when lang = 'en' then 1 else 0 end)::bigint as en,
        sum(case when lang = 'es' then 1 else 0 end)::bigint as es, sum(case when lang = 'fr' then 1 else 0 end)::bigint as fr from documents group by source""")
def compare_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count()
    return counted.na.fill(0)


# --- language, scores, order ----------------------------------------------------------------------

#: Marker words by language; a language's share is the share of a text's words that are its markers.
MARKERS = {
    "en": "the and of to in is you that it for".split(),
    "es": "el la de que y en un ser se no".split(),
    "fr": "le de un et en que pour dans ce il".split(),
    "de": "der die und in den von zu das mit sich".split(),
}


@query(f"""
    with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^0-9a-z_]+'), lambda x: x <> '') as words from documents)
    select doc_id, len(words) as n_words, {', '.join(f"len(list_filter(words, lambda x: list_contains({_list(m)}, x))) as n_{k}" for k, m in MARKERS.items())} from w""")
def lang_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker words of four languages in ASCII words, as the ratio-based detector counts them."""
    words = F.filter(F.split(F.lower("text"), "[^0-9a-z_]+"), lambda w: w != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("words"))
    counts = [_hits(marks).alias(f"n_{name}") for name, marks in MARKERS.items()]
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), *counts)


def _hits(marks: list[str]):
    return F.size(F.filter("words", lambda w: w.isin(marks))).cast("long")


@query("""
    with v as (select doc_id, (doc_id % 4)::int as malicious, (doc_id % 3)::int as suspicious, (doc_id % 101)::int as confidence, date '2024-01-01' - (doc_id % 400)::int as created,
                      case doc_id % 4 when 0 then 'reject' when 1 then 'quarantine' when 2 then 'none' end as p, case doc_id % 3 when 0 then 'v=spf1 mx -all' when 1 then 'v=spf1 ~all' else 'v=spf1 ?all' end as spf, source || '.example.com' as target from documents)
    select doc_id, case when malicious > 0 then 'malicious' when suspicious > 0 then 'suspicious' else 'clean' end as reputation,
        case when confidence >= 50 then 'high' when confidence >= 25 then 'elevated' else 'low' end as abuse,
        case when date '2024-01-01' - created <= 30 then 'bad' when date '2024-01-01' - created <= 180 then 'warn' else 'fine' end as age,
        case p when 'reject' then 'good' when 'quarantine' then 'good' when 'none' then 'weak' else 'missing' end as dmarc,
        case when spf like '%-all' then 'strict' when spf like '%~all' then 'soft' else 'open' end as spf,
        regexp_full_match(target, '([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?[.])+[a-z]{2,63}') as valid
    from v""")
def lookup_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that judge answers of lookups, on answers derived from ids."""
    from ..operators import lookups

    n = F.col("doc_id")
    policy = F.when(n % 4 == 0, "reject").when(n % 4 == 1, "quarantine").when(n % 4 == 2, "none")
    spf = F.when(n % 3 == 0, "v=spf1 mx -all").when(n % 3 == 1, "v=spf1 ~all").otherwise("v=spf1 ?all")
    today = F.lit("2024-01-01").cast("date")
    return table(spark, sf_dir, "documents").select(
        "doc_id", lookups.reputation(n % 4, n % 3).alias("reputation"), lookups.abuse_level(n % 101).alias("abuse"), lookups.domain_age(F.date_sub(today, (n % 400).cast("int")), today).alias("age"),
        lookups.dmarc_strength(policy).alias("dmarc"), lookups.spf_strength(spf).alias("spf"), lookups.valid_domain(F.concat("source", F.lit(".example.com"))).alias("valid"),
    )


@query()
def phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the default phrases and the patterns in every document, by category. No SQL: matches
    never overlap, a strong or longer one wins."""
    from ..operators import language

    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("msg_id"), "text")
    return language.category_scores(language.matches(texts)).withColumnRenamed("msg_id", "doc_id")


@query()
def page_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the pages send data and what they carry, read statically. No SQL: layers are decoded."""
    from ..functions import htmlscan

    return htmlscan.inspected(table(spark, sf_dir, "pages"), "page_id", "html")



@query("""
    select distinct url as destination, 'Unwrapped: ' || label as note
    from pages cross join (values ('Microsoft Defender Safe Links'), ('Google redirect')) as g(label) where url like 'http%'""")
def unwrapped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages, wrapped by two gateways and taken out again."""
    from ..functions import urldecode

    inside = F.url_encode("url")
    links = F.array(F.concat(F.lit("https://eur01.safelinks.protection.outlook.com/?data=1&url="), inside), F.concat(F.lit("https://www.google.com/url?sa=t&q="), inside))
    rows = table(spark, sf_dir, "pages").where(F.col("url").startswith("http")).select(F.explode(links).alias("url"))
    return urldecode.destinations(rows).select("destination", "note")


_TERMS = {"urgency": ["now", "today", "urgent"], "authority": ["on", "with", "are"], "social": ["you", "this", "from"]}


@query(f"""
    with w as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^0-9a-z]+'), lambda x: x <> '')) as word from documents),
         k as (select unnest({_list([c for c, t in _TERMS.items() for _ in t])}) as category, unnest({_list([x for t in _TERMS.values() for x in t])}) as term)
    select category, doc_id, count(*) as n_hits, least(count(*) * 10, 100) as score from w join k on word = term group by 1, 2""")
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-word terms of categories: tokens meet the term table, hits are counted and capped."""
    terms = spark.createDataFrame([(c, t) for c, words in _TERMS.items() for t in words], "category string, term string")
    wanted = [t for words in _TERMS.values() for t in words]
    # Only the words of the table leave the document's row.
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(F.split(F.lower("text"), "[^0-9a-z]+"), lambda w: w.isin(wanted))).alias("word"))
    # The term table is written in the code: its size is fixed.
    hits = words.join(F.broadcast(terms), words["word"] == terms["term"]).groupBy("category", "doc_id").agg(F.count("*").alias("n_hits"))
    return hits.withColumn("score", F.least(F.col("n_hits") * 10, F.lit(100).cast("long")))


_BRANDS = [n for n in refdata.BRANDS if len(n) >= 5]


@query(f"""
    with h as (select distinct {_HOST} as host from pages), s as (select host, {_skeleton(f"split_part({_org('host')}, '.', 1)")} as shape from h where host <> ''),
         b as (select unnest({_list(_BRANDS)}) as brand)
    select host, shape, min(levenshtein(shape, brand)) as distance from s, b group by host, shape""")
def levenshtein_lookalike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least edit distance of each host's name to a brand; the brands are literals, no join is needed."""
    hosts = table(spark, sf_dir, "pages").select(net.url_host(F.col("url")).alias("host")).where("host is not null").distinct()
    shaped = hosts.select("host", net.skeleton(F.substring_index(net.org_domain(F.col("host")), ".", 1)).alias("shape"))
    return shaped.select("host", "shape", F.least(*[F.levenshtein("shape", F.lit(b)) for b in _BRANDS]).cast("long").alias("distance"))


@query(f"""
    with h as (select distinct {_HOST} as host from pages where {_HOST} <> ''), s as (select host, {_skeleton(f"split_part({_org('host')}, '.', 1)")} as shape, split_part({_org('host')}, '.', 1) as name from h)
    select host, list_contains({_list(refdata.BRANDS)}, shape) and shape <> name as confusable from s""")
def confusable_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(net.url_host(F.col("url")).alias("host")).where("host is not null").distinct()
    return hosts.select("host", F.coalesce(net.lookalike(F.col("host"))["kind"] == "confusable", F.lit(False)).alias("confusable"))


@query(r"""
    with n as (select d.doc_id, len(regexp_extract_all(text, '[0-9]{6,}')) as high, len(regexp_extract_all(text, '[!?]{2,}')) as medium, coalesce(l.toxic, 0) as toxic from documents d left join labels l on l.doc_id = d.doc_id),
         s as (select doc_id, (case when high > 0 then 25 + least(high - 1, 4) * 12 else 0 end) + (case when medium > 0 then 8 + least(medium - 1, 4) * 4 else 0 end) + toxic * 30 as raw from n)
    select doc_id, least(raw, 100) as score, case when raw >= 60 then 'High Risk' when raw >= 30 then 'Suspicious' else 'Low Risk' end as tier,
        row_number() over (order by case when raw >= 60 then 0 when raw >= 30 then 1 else 2 end, least(raw, 100) desc, doc_id) as place from s""")
def risk_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diminishing counts, capped score, tier and place in the batch."""
    from ..operators import score

    t = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(t, F.lit("[0-9]{6,}")).alias("high"), F.regexp_count(t, F.lit("[!?]{2,}")).alias("medium"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    raw = text.diminishing(F.col("high"), 25, 12) + text.diminishing(F.col("medium"), 8, 4) + F.coalesce("toxic", F.lit(0)) * 30
    scored = docs.join(labels, "doc_id", "left").select("doc_id", score.clamped(raw.cast("double")).cast("long").alias("score"))
    return score.ranked(scored.withColumn("tier", score.tier(F.col("score"))), "doc_id")


@query("""
    select user_id, count(*) as n_hops, sum(case when ts < prev - interval 60 second then 1 else 0 end)::bigint as n_backwards, max(n - i + 1) as n_first
    from (select user_id, ts, lag(ts) over w as prev, row_number() over w as i, count(*) over (partition by user_id) as n from events window w as (partition by user_id order by event_id)) group by user_id""")
def hop_time_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clocks that run backwards by more than a minute from one hop to the next; n_first is the first hop's
    place, counted from the last."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    hops = table(spark, sf_dir, "events").select("user_id", "ts", F.lag("ts").over(order).alias("prev"), F.row_number().over(order).alias("i"))
    back = F.col("ts") < F.col("prev") - F.expr("interval 60 seconds")
    return hops.groupBy("user_id").agg(F.count("*").alias("n_hops"), F.coalesce(F.count_if(back), F.lit(0)).alias("n_backwards"), (F.count("*") - F.min("i") + 1).alias("n_first"))


@query("""
    with s as (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as before from conversations)
    select conv_id, count(*) as n_turns, count(distinct role) as n_roles, sum(case when before = role then 1 else 0 end)::bigint as n_same, arg_min(role, turn) as opener from s group by conv_id""")
def thread_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    turns = turns.withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.countDistinct("role").alias("n_roles"), F.count_if(F.col("before") == F.col("role")).alias("n_same"), F.min_by("role", "turn").alias("opener")
    )


@query(r"""
    select doc_id, len(list_distinct(list_filter(regexp_extract_all(text, '[\p{L}\p{M}]{3,}'), lambda w: regexp_matches(w, '\p{Latin}') and regexp_matches(w, '[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}]')))) as n_mixed,
        regexp_matches(text, '[\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200E}\x{200F}]') as bidi
    from documents""")
def unicode_tricks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.mixed_script_words(t)).cast("long").alias("n_mixed"), text.bidi_control(t).alias("bidi"))
