"""From raw messages to verdicts: the whole per-message pipeline and the batch view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from ..functions import refdata as R
from ..functions import text as T
from ..operators import auth, identity, iocs, language, score, thread
from ..sources import messages as M
from ..sources import mime


def _has(risks: Column, *kinds: str) -> Column:
    return F.exists(risks, lambda u: F.exists(u["risks"], lambda r: r["type"].isin(*kinds)))


def auth_points(rows: DataFrame) -> Column:
    """Points of findings, results, misalignment, distrust and anomalies; a clean pass takes ten off."""
    found = F.aggregate("findings", F.lit(0), lambda n, f: n + F.when(f["severity"] == "high", 20).otherwise(8))
    odd = F.aggregate("anomalies", F.lit(0), lambda n, a: n + F.when(a["severity"] == "high", 12).when(a["severity"] == "medium", 6).otherwise(3))
    results = score.points_of(F.col("spf.status"), R.SPF_POINTS) + score.points_of(F.col("dkim.status"), R.DKIM_POINTS) + score.points_of(F.col("dmarc.status"), R.DMARC_POINTS)
    aligned = F.col("alignment.dmarc_aligned")
    apart = F.when(aligned == F.lit(False), 30).otherwise(0) + F.when(F.col("alignment.reply_to_mismatch"), 8).otherwise(0)
    clean = (F.col("spf.status") == "pass") & (F.col("dkim.status") == "pass") & (F.col("dmarc.status") == "pass") & F.coalesce(aligned, F.lit(False))
    return F.greatest(F.lit(0), found + results + apart + F.size("trust.warnings") * 12 + odd - F.when(clean, 10).otherwise(0))


def ioc_points() -> Column:
    urls = F.col("iocs.urls")
    high = F.size(F.filter(urls, lambda u: F.exists(u["risks"], lambda r: r["level"] == "high")))
    medium = F.size(F.filter(urls, lambda u: F.exists(u["risks"], lambda r: r["level"] == "medium") & ~F.exists(u["risks"], lambda r: r["level"] == "high")))
    files = F.size(F.filter("file_risks", lambda f: F.exists(f["risks"], lambda r: r["level"] == "high")))
    punycode = F.size(F.filter(F.col("iocs.domains"), lambda d: d["punycode"]))
    disposable = F.when(F.exists(F.col("iocs.emails"), lambda e: e["disposable"]), 10).otherwise(0)
    form = F.when(F.col("password_form"), 25).otherwise(0)
    return T.diminishing(high, 25, 12) + T.diminishing(medium, 8, 4) + T.diminishing(files, 30, 15) + T.diminishing(punycode, 20, 10) + disposable + form


def file_risks() -> Column:
    """array of struct(value, within, sha256, md5, sniffed, risks) for the files of a message: by name,
    by bytes, and by what a page would do."""

    def one(f: Column) -> Column:
        kind, name = T.sniffed(f["bytes"]), T.stripped(f["filename"])

        def judged(k: Column) -> Column:
            program = k.isin(*T.PROGRAMS)
            first = F.array_compact(F.array(
                iocs.risk(T.bidi_control(f["filename"]), "rtlo-name", "high"), iocs.risk(T.double_extension(name), "double-extension", "high"), iocs.risk(f["login"], "login-form", "high"),
            ))
            served = F.transform(F.coalesce(f["services"], F.array().cast("array<string>")), lambda s: F.struct(F.lit("exfil").alias("type"), F.lit("high").alias("level")))
            last = F.array_compact(F.array(
                iocs.risk(f["carried"] > 0, "smuggled-file", "high"), iocs.risk(f["layers"] > 0, "hidden-layer", "medium"), iocs.risk(program, "executable-content", "high"),
                iocs.risk(~program & ~T.belongs(k, T.extension_of(name)), "type-mismatch", "medium"), iocs.risk(f["smuggling"], "html-smuggling", "high"), iocs.risk(f["scripted"], "scripted-page", "medium"),
                iocs.risk(k.isin("RAR", "7-Zip", "GZIP"), "archive", "medium"), iocs.risk(T.risky_extension(name), "risky-extension", "high"),
            ))
            risks = F.concat(first, served, last)
            return F.struct(f["filename"].alias("value"), f["within"].alias("within"), F.sha2(f["bytes"], 256).alias("sha256"), F.md5(f["bytes"]).alias("md5"), k.alias("sniffed"), risks.alias("risks"))

        return net.let(kind, judged)

    return F.transform("files", one)


def analyze(messages: DataFrame, own_domains: tuple[str, ...] = (), phrases: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """messages (msg_id, raw) to one wide row each: headers, authentication, body, indicators,
    findings, points, score, tier, attack types, reasons and caveats. Texts without a message header
    go, as do messages that can't be taken apart (rejects() has them).

    Nothing is shuffled: rows of equal msg_id are messages of their own.
    """
    # The Arrow pass comes first: it takes the text alone, and what a caller leaves out is not computed.
    bodies = mime.parse_bodies(messages).where("parse_error is null").drop("parse_error")
    rows = auth.authenticate(M.parse_headers(bodies).where(M.is_message(F.col("headers"))))
    matcher = language.compiled(phrases)
    rows = thread.with_thread(identity.with_findings(rows, own=own_domains), matcher)
    rows = rows.withColumn("hits", language.hits(F.col("body_text"), matcher))
    told = thread.thread_findings(F.col("headers"), F.col("quoted"), F.col("separators"), auth.sent_at(F.col("headers.date")))
    rows = rows.withColumn("findings", F.concat("findings", thread.with_payment(told, F.col("quoted"), language.n_strong(F.col("quoted_hits"), "bec")))).drop("quoted_hits")
    rows = iocs.with_iocs(rows).withColumn("file_risks", file_risks()).withColumn("password_form", F.coalesce("body_page.login", F.lit(False)))
    rows = rows.withColumn("strong", language.strong_map(F.col("hits")))
    parts = {"auth_points": auth_points(rows), "ioc_points": ioc_points(), "language_points": language.points_of(F.col("strong"))}
    return with_verdict(rows.withColumns({k: score.clamped(v.cast("double")) for k, v in parts.items()}))


def rejects(messages: DataFrame) -> DataFrame:
    """(msg_id, reason) of the rows that analyze() leaves out: files with an error of their own (where
    messages have that column), empty texts, texts without a message header, and messages that can't be
    taken apart."""
    own = F.col("error") if "error" in messages.columns else F.lit(None).cast("string")
    empty = F.trim(F.coalesce("raw", F.lit(""))) == ""
    headed = F.coalesce(M.is_message(F.col("headers")), F.lit(False))
    rows = M.parse_headers(messages.select("msg_id", "raw", own.alias("error")))
    rows = rows.select("msg_id", "raw", F.coalesce("error", F.when(~headed, F.when(empty, "empty").otherwise("no message header"))).alias("reason"))
    # One pass for both kinds: texts that have a reason already are not read again.
    read = mime.parse_bodies(rows.select("msg_id", F.when(F.col("reason").isNull(), F.col("raw")).alias("raw"), "reason"))
    return read.select("msg_id", F.coalesce("reason", "parse_error").alias("reason")).where("reason is not null")


PHONE = r"[0-9][0-9\s().-]{7,}[0-9]"


def with_verdict(rows: DataFrame) -> DataFrame:
    """score, tier, attack_types, reasons and caveats from the points, with the floors that decisive
    findings set."""

    def strong(category: str) -> Column:
        return language.strong_count(F.col("strong"), category)

    urls, files, form = F.col("iocs.urls"), F.col("file_risks"), F.col("password_form")
    business, blackmail, fee, prize = strong("bec") >= 2, strong("extortion") >= 2, strong("advancefee") >= 3, strong("lure") >= 2
    leak, smuggled = _has(urls, "exfil-endpoint") | _has(files, "exfil"), _has(files, "smuggled-file")
    renamed, program = _has(files, "rtlo-name"), _has(files, "executable-content")
    login, typed = _has(files, "login-form"), _has(urls, "credential-form")
    ids = F.transform("findings", lambda f: f["id"])
    fabricated = F.exists("findings", lambda f: (f["module"] == "thread") & (f["severity"] == "high"))
    points = score.total(F.col("auth_points"), F.col("ioc_points"), F.col("language_points"))
    floor = F.when(leak | smuggled | renamed | program, R.TIER_HIGH).when(business | blackmail | fee | fabricated | login | form | typed, R.TIER_SUSPICIOUS).otherwise(0)

    spoofed = (F.col("dmarc.status") == "fail") | F.coalesce(F.col("alignment.dmarc_aligned") == F.lit(False), F.lit(False))
    page = ("login-form", "exfil", "hidden-layer")
    harmful = F.exists(files, lambda f: F.exists(f["risks"], lambda r: r["level"] == "high") & F.exists(f["risks"], lambda r: ~r["type"].isin(*page)))
    dialled = F.exists("hits", lambda m: (m["category"] == "social") & (m["tier"] == "strong") & m["phrase"].rlike(PHONE)) & ~F.exists(urls, lambda u: ~u["value"].rlike(r"(?i)\Amailto:"))
    asked = (strong("credential") >= 1) & ((F.size(urls) > 0) | (F.size(files) > 0))
    types = F.array_compact(F.array(
        F.when(business | F.array_contains(ids, "thread-payment"), F.lit("BEC / payment fraud")),
        F.when(form | leak | login | typed | asked, F.lit("Credential phishing")),
        F.when(harmful | _has(urls, "direct-download") | smuggled | program, F.lit("Malware delivery")),
        F.when(blackmail, F.lit("Extortion / sextortion")), F.when(fee, F.lit("Advance-fee scam")), F.when(dialled, F.lit("Callback phishing")), F.when(prize, F.lit("Prize / reward scam")),
        F.when(F.exists(ids, lambda i: i.rlike("lookalike|display-name|own-|mixed-script|thread-impersonation")), F.lit("Impersonation")), F.when(spoofed, F.lit("Sender spoofing")),
    ))
    reasons = F.array_compact(F.array(
        F.when(leak, F.lit("decisive: a page sends what is typed to a collecting service")), F.when(smuggled, F.lit("decisive: a page carries a file inside itself")),
        F.when(renamed, F.lit("decisive: a file name hides its extension")), F.when(program, F.lit("decisive: a file is a program")),
        F.when(fabricated, F.lit("the quoted conversation looks made up")), F.when(login, F.lit("a login page is attached")), F.when(form, F.lit("the message asks for a password")),
        F.when(typed, F.lit("a form sends passwords to another address")), F.when(business, F.lit("it presses for a payment")), F.when(blackmail, F.lit("it threatens to expose the reader")),
        F.when(fee, F.lit("it asks for a fee before a payout")),
    ))
    noted = F.transform(F.filter("findings", lambda f: f["severity"] == "high"), lambda f: f["title"])
    worded = F.transform(F.filter(F.map_entries("strong"), lambda e: e["value"] > 0), lambda e: F.concat(e["key"], F.lit(" wording: "), e["value"].cast("string")))
    linked = F.transform(F.array_distinct(F.flatten(F.transform(urls, lambda u: F.transform(u["risks"], lambda r: r["type"])))), lambda t: F.concat(F.lit("link: "), t))
    # What a low score does not say.
    told, routed = (F.col("trust.n_results") > 0) | (F.col("spf.n_sources") > 0), F.size("route") > 0
    forwarded = F.col("headers.subject").rlike(r"(?i)\A\s*(?:fw|fwd)\s*:")
    caveats = F.array_compact(F.array(
        F.when(forwarded, F.lit("forwarded: the headers are the forwarder's")), F.when(~told & ~routed, F.lit("neither authentication nor route is recorded")).when(~told, F.lit("no authentication is recorded")),
        F.when(business, F.lit("confirm payments by a known telephone number")), F.when(blackmail, F.lit("threats like these are nearly always bluff")), F.when(fee, F.lit("nothing is ever paid out after a fee")),
    ))
    rows = rows.withColumn("score", F.greatest(points, floor).cast("int")).withColumn("caveats", caveats).withColumn("reasons", F.array_distinct(F.concat(reasons, noted, linked, worded)))
    return rows.withColumn("tier", score.tier(F.col("score"))).withColumn("attack_types", types)


def message_indicators(analyzed: DataFrame) -> DataFrame:
    """(msg, type, value) of analyzed messages, for correlate.shared(). All indicators of a message
    are one array, so the pipeline before runs once."""
    h = F.col("headers")
    sender = F.lower(F.substring_index(h["from"]["email"], "@", -1))
    single = {
        "from": h["from"]["email"], "domain": sender, "replyTo": h["reply_to"]["email"], "displayName": h["from"]["name"], "ip": F.col("sender_ip.public_ip"),
        "subject": T.subject_key(h["subject"]), "messageIdDomain": F.regexp_extract(h["message_id"], r"@([^>\s]+)", 1), "mailer": h["x_mailer"],
    }
    urls, files = F.col("iocs.urls"), F.col("file_risks")
    lists = {"url": (urls, "value"), "urlDomain": (urls, "host"), "hash": (files, "sha256"), "filename": (files, "value")}

    def item(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lower(value.cast("string")).alias("value"))

    one = F.array(*[item(k, v) for k, v in single.items()], item("domain", net.org_domain(sender)))
    def items(kind: str, of: Column, field: str) -> Column:
        return F.transform(of, lambda x: item(kind, x[field]))

    many = [items(kind, of, field) for kind, (of, field) in lists.items()]
    every = F.array_distinct(F.filter(F.concat(one, *[F.coalesce(m, F.array().cast("array<struct<type:string,value:string>>")) for m in many]), lambda i: i["value"] != ""))
    return analyzed.select(F.col("msg_id").alias("msg"), F.explode_outer(every).alias("i")).where("i is not null").select("msg", "i.type", "i.value").dropDuplicates(["msg", "type", "value"])
