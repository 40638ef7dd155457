"""Indicators of compromise of a message: URLs, domains, addresses, with their risks.

A wide row per message keeps arrays; indicator_rows() gives the long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from ..functions import refdata as R

URL = r"""(?i)https?://[^\s<>"')\]]+"""

# Throw-away mail providers.
DISPOSABLE = "tempmail.com 10minutemail.com guerrillamail.com mailinator.com throwaway.email temp-mail.org fakeinbox.com trashmail.com yopmail.com sharklasers.com guerrillamail.info grr.la".split()


def risk(test: Column, kind: str, level: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(kind).alias("type"), F.lit(level).alias("level")))


def url_risks(url: Column, mismatch: Column | None = None, service: Column | None = None, asks: Column | None = None) -> Column:
    """array of struct(type, level): what speaks against a link, in a fixed order. service is the
    collecting service it belongs to, asks tells whether a password form sends to it."""
    low = F.lower(url)
    after = F.regexp_extract(low, r"\A[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(low, r"\A[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    scheme = F.regexp_extract(low, r"\A([a-z][a-z0-9+.-]*):", 1)
    parts = F.struct(net.url_host(url).alias("host"), scheme.alias("scheme"), after.alias("after"), F.regexp_extract(after, r":([0-9]+)\z", 1).alias("port"), F.regexp_extract(path, r"\.([a-z0-9]+)/?\z", 1).alias("ending"))
    return net.let(parts, lambda x: _risks_of(x, mismatch, service, asks))


def _risks_of(x: Column, mismatch: Column | None, service: Column | None, asks: Column | None) -> Column:
    host, scheme, after, port, ending = (x[k] for k in ("host", "scheme", "after", "port", "ending"))
    tests = [
        risk(scheme.isin("javascript", "vbscript", "data"), "script-url", "high"), risk(after.contains("@"), "credentials-url", "high"),
        risk((port != "") & ~port.isin("80", "443"), "odd-port", "medium"), risk(ending.isin(R.EXECUTABLE_URL_EXTENSIONS), "direct-download", "high"),
        risk(ending.isin(R.ARCHIVE_URL_EXTENSIONS), "direct-download", "medium"), risk(net.risky_tld(host), "risky-tld", "medium"), risk(net.lookalike(host).isNotNull(), "brand-lookalike", "high"),
        risk(net.under_domain(host, R.SHORTENERS), "url-shortener", "medium"), risk(host.contains("xn--"), "punycode", "high"), risk(net.valid_ipv4(host) | F.startswith(host, F.lit("[")), "ip-url", "high"),
    ]
    if service is not None:
        tests.append(risk(service.isNotNull(), "exfil-endpoint", "high"))
    if asks is not None:
        tests.append(risk(asks, "credential-form", "high"))
    if mismatch is not None:
        tests.append(risk(mismatch, "mismatch", "high"))
    return F.array_compact(F.array(*tests))


def behind(wrapped: Column) -> Column:
    """The address behind each wrapped link, as a map."""
    return F.map_from_entries(F.transform(wrapped, lambda w: F.struct(w["url"], w["destination"])))


def deceptive(label: Column, href: Column) -> Column:
    """Whether a link's visible text is a host of another organisation than its target's. A gateway's
    rewriting is no deception: href is the address behind it."""
    shown = F.when(label.rlike(r"(?i)\A\s*https?://"), net.url_host(F.trim(label))).when(label.rlike(r"(?i)\A\s*(www\.)?[a-z0-9-]+(\.[a-z0-9-]+)+(/\S*)?\s*\z"), net.url_host(F.concat(F.lit("http://"), F.trim(label))))
    return F.coalesce(net.org_domain(shown) != net.org_domain(net.url_host(href)), F.lit(False))


#: Where addresses are found, the more telling place first.
IP_SOURCES = ("X-Originating-IP", "Received", "Body")


def ip_lists(headers: Column, route: Column, text: Column) -> dict[str, Column]:
    """The addresses of each of IP_SOURCES, as written, in order."""
    routed = F.array_distinct(F.flatten(F.transform(route, lambda x: x["ips"])))
    return dict(zip(IP_SOURCES, (net.find_ips(F.coalesce(headers["x_originating_ip"], F.lit(""))), routed, net.find_ips(text)), strict=True))


def ip_mentions(headers: Column, route: Column, text: Column) -> Column:
    """array of struct(value, source, rank, place): every mention of an address in a message."""
    parts = [F.transform(found, lambda v, i: F.struct(v.alias("value"), F.lit(s).alias("source"), F.lit(r).alias("rank"), i.alias("place"))) for r, (s, found) in enumerate(ip_lists(headers, route, text).items())]
    return F.concat(*parts)


def by_source(lists: Column, common: Column) -> Column:
    """array of struct(value, private, source, sources): each address once, with the first of the
    sources that mention it and all of them. common: those of the headers that the body has as well.
    Headers hold few addresses, so looking them up is short."""
    known = [lists[s] for s in IP_SOURCES]
    every = F.concat(known[0], F.array_except(known[1], known[0]), F.array_except(known[2], F.concat(known[0], known[1])))

    def one(v: Column) -> Column:
        told = F.array_compact(F.array(*[F.when(F.array_contains(k, v), F.lit(s)) for k, s in zip(known[:2], IP_SOURCES[:2], strict=True)]))
        # What neither header mentions is from the body, whose list may be long.
        also = F.when((F.size(told) == 0) | F.array_contains(common, v), F.concat(told, F.array(F.lit(IP_SOURCES[2])))).otherwise(told)
        return F.struct(v.alias("value"), net.private_ip(v).alias("private"), also[0].alias("source"), also.alias("sources"))

    return F.transform(every, one)


def with_iocs(rows: DataFrame) -> DataFrame:
    """rows (headers, body_text, links, destinations, wrapped) with the column `iocs`: urls, domains,
    ips, emails. Addresses that pages send data to, and those behind wrapped links, are links too; a
    value has its first source."""
    h = F.col("headers")
    text = F.coalesce("body_text", F.lit(""))
    def link(value: Column, source: str) -> Column:
        return F.struct(value.alias("value"), F.lit(source).alias("source"), F.lit(False).alias("mismatch"), F.lit(None).cast("string").alias("service"), F.lit(False).alias("asks"))

    def values(items: Column, field: str = "value") -> Column:
        return F.transform(items, lambda u: u[field])

    def links(targets: Column) -> Column:
        kept = F.filter("links", lambda x: x["href"] != "")
        return F.transform(kept, lambda x: F.struct(x["href"].alias("value"), deceptive(x["label"], F.coalesce(F.try_element_at(targets, x["href"]), x["href"])).alias("mismatch")))

    linked = net.let(behind(F.col("wrapped")), links)
    parts = F.struct(F.array_distinct(F.regexp_extract_all(text, F.lit(URL), F.lit(0))).alias("text"), linked.alias("link"), F.col("destinations").alias("page"))

    def every(x: Column) -> Column:
        """One struct for each value. Sets of values are hashed; deceptive links and addresses of
        collectors are few, so looking them up stays short."""
        names = F.struct(
            x["text"].alias("text"), F.array_except(values(x["link"]), x["text"]).alias("link"), F.array_except(values(x["page"], "url"), F.concat(x["text"], values(x["link"]))).alias("page"),
            F.array_distinct(values(F.filter(x["link"], lambda u: u["mismatch"]))).alias("deceptive"), F.array_distinct(values(F.filter(x["page"], lambda d: d["asks"]), "url")).alias("asking"),
            F.filter(x["page"], lambda d: d["service"].isNotNull()).alias("served"),
        )

        def build(k: Column) -> Column:
            def own(source: str) -> Column:
                return F.transform(k[source], lambda v: F.struct(
                    v.alias("value"), F.lit(source).alias("source"), F.array_contains(k["deceptive"], v).alias("mismatch"),
                    F.get(F.filter(k["served"], lambda d: d["url"] == v), F.lit(0))["service"].alias("service"), F.array_contains(k["asking"], v).alias("asks"),
                ))

            known = F.concat(k["text"], k["link"], k["page"])
            behind = F.filter("wrapped", lambda w: F.array_contains(known, w["url"]) & ~F.array_contains(known, w["destination"]))
            return F.concat(*[own(source) for source in ("text", "link", "page")], F.transform(F.array_distinct(values(behind, "destination")), lambda v: link(v, "unwrapped")))

        return net.let(names, build)

    rows = rows.withColumn("_urls", net.let(parts, every))
    urls = F.transform("_urls", lambda u: F.struct(u["value"].alias("value"), net.url_host(u["value"]).alias("host"), u["mismatch"].alias("mismatch"), u["source"].alias("source"), u["service"].alias("service"), url_risks(u["value"], u["mismatch"], u["service"], u["asks"]).alias("risks")))
    senders = F.array_compact(F.array(h["from"]["email"], h["reply_to"]["email"], h["return_path"]["email"]))
    emails = F.array_distinct(F.concat(senders, net.find_emails(text)))
    flagged = F.transform(emails, lambda e: F.struct(e.alias("value"), net.under_domain(F.substring_index(e, "@", -1), DISPOSABLE).alias("disposable")))
    flagged_ips = net.let(F.struct(*[v.alias(k) for k, v in ip_lists(h, F.col("route"), text).items()]), lambda x: by_source(x, F.array_intersect(F.concat(*[x[s] for s in IP_SOURCES[:2]]), x[IP_SOURCES[2]])))
    hosts = F.filter(F.transform("_urls", lambda u: net.url_host(u["value"])), lambda x: x.isNotNull())
    named = F.transform(senders, lambda e: F.substring_index(e, "@", -1))
    message_id = F.array_compact(F.array(F.nullif(F.lower(F.regexp_extract(h["message_id"], r"@([^>]+)", 1)), F.lit(""))))
    domains = F.filter(F.array_distinct(F.concat(message_id, named, hosts)), lambda d: d.contains(".") & ~net.valid_ipv4(d))
    flagged_domains = F.transform(domains, lambda d: F.struct(d.alias("value"), d.contains("xn--").alias("punycode")))
    return rows.withColumn("iocs", F.struct(urls.alias("urls"), flagged_domains.alias("domains"), flagged_ips.alias("ips"), flagged.alias("emails"))).drop("_urls")


def indicator_rows(rows: DataFrame) -> DataFrame:
    """(msg_id, kind, value, ord, risks): the long form of iocs."""
    none = F.array().cast("array<struct<type:string,level:string>>")
    parts = []
    for kind in ("urls", "domains", "ips", "emails"):
        risks = (lambda x: x["risks"]) if kind == "urls" else (lambda x: none)
        parts.append(rows.select("msg_id", F.lit(kind[:-1]).alias("kind"), F.posexplode(_pairs(kind, risks)).alias("ord", "i")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("msg_id", "kind", "i.value", "ord", "i.risks")


def _pairs(kind: str, risks) -> Column:
    return F.transform(F.col("iocs")[kind], lambda x: F.struct(x["value"].alias("value"), risks(x).alias("risks")))
