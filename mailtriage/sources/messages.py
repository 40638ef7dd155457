"""Raw messages as tables: files in, parsed header columns out. No Python runs on the data here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import charsets
from ..functions.net import let
from ..functions.text import trimmed
from . import mailsource

# A text is a message if it has one of these headers.
EMAIL_HEADERS = "from to subject date message-id received return-path reply-to mime-version content-type dkim-signature authentication-results delivered-to".split()

# Headers that may occur once.
SINGLE_HEADERS = "from subject reply-to return-path date to".split()


def read_messages(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """msg_id, name, content, error of the .eml and .txt files below path (see mailsource); a file with
    an error has no content."""
    files = mailsource.read(spark, path, **options)
    return files.select(F.sha2("path", 256).alias("msg_id"), "name", "content", "error")


def with_raw(messages: DataFrame) -> DataFrame:
    """content (binary) as raw text: UTF-8, with bytes that aren't replaced."""
    return messages.withColumn("raw", F.make_valid_utf8(F.col("content").cast("string")))


def message_kind(raw: Column) -> Column:
    """`full` for a message with an empty line, or with more long lines of prose than header lines;
    else `headers`."""
    lines = F.split(raw, r"\r?\n")
    named = F.size(F.filter(lines, lambda x: x.rlike(r"\A[A-Za-z0-9_-]+:")))
    prose = F.size(F.filter(lines, lambda x: (F.length(x) > 50) & ~x.rlike(r"\A(?:[A-Za-z0-9_-]+:|\s)")))
    return F.when(raw.contains("\n\n") | raw.contains("\r\n\r\n") | (prose > named), "full").when(raw.isNotNull(), "headers")


def head_end(raw: Column) -> Column:
    """Number of characters before the first empty line, or of all."""
    crlf, lf = F.locate("\r\n\r\n", raw), F.locate("\n\n", raw)
    return F.when((crlf > 0) & ((lf == 0) | (crlf < lf)), crlf - 1).when(lf > 0, lf - 1).otherwise(F.length(raw))


def body_of(raw: Column) -> Column:
    """What follows the first empty line; empty without one."""
    crlf, lf = F.locate("\r\n\r\n", raw), F.locate("\n\n", raw)
    at = F.when((crlf > 0) & ((lf == 0) | (crlf < lf)), crlf + 4).when(lf > 0, lf + 2)
    return F.coalesce(F.substr(raw, at), F.lit(""))


def header_lines(raw: Column) -> Column:
    """array of struct(name, value, key) in order: folded lines joined, names without blanks."""
    unfolded = F.regexp_replace(F.substr(raw, F.lit(1), head_end(raw)), r"\r?\n[ \t]+", " ")
    lines = F.filter(F.split(unfolded, r"\r?\n"), lambda x: F.locate(":", x) > 1)
    parts = F.transform(
        lines,
        lambda x: F.struct(
            F.substring_index(x, ":", 1).alias("name"),
            trimmed(F.substr(x, F.locate(":", x) + 1)).alias("value"),
            F.lower(trimmed(F.substring_index(x, ":", 1))).alias("key"),
        ),
    )
    return F.filter(parts, lambda p: p["name"].rlike(r"\A[\x21-\x39\x3b-\x7e]+\z"))


def all_of(headers: Column, key: str) -> Column:
    """The non-empty values of a header, topmost first."""
    return F.transform(F.filter(headers, lambda h: (h["key"] == key) & (h["value"] != "")), lambda h: h["value"])


def first_of(headers: Column, key: str) -> Column:
    return F.try_element_at(all_of(headers, key), F.lit(1))


def address(value: Column) -> Column:
    """struct(raw, email, name): the address in angle brackets, or a bare one, or the first that looks like one."""

    def chosen(x: Column) -> Column:
        angle = x["inside"].rlike(r"\A[^\s<>]+@[^\s<>]+\.[^\s<>]+\z")
        email = F.when(angle, x["inside"]).when(x["plain"] != "", x["plain"]).when(x["loose"] != "", x["loose"])
        return F.when(x["raw"].isNotNull(), F.struct(x["raw"].alias("raw"), email.alias("email"), F.when(angle & (x["name"] != ""), x["name"]).alias("name")))

    def read(x: Column) -> Column:
        inside = F.lower(trimmed(F.regexp_extract(x["clean"], r"<([^>]+)>", 1)))
        name = trimmed(F.regexp_replace(F.regexp_replace(x["clean"], r"<[^>]+>", ""), '"', ""))
        plain = F.lower(F.regexp_extract(x["clean"], r"([^\s<>;,]+@[^\s<>;,]+\.[^\s<>;,]+)", 1))
        loose = F.lower(F.regexp_extract(x["raw"], r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", 1))
        return let(F.struct(x["raw"].alias("raw"), inside.alias("inside"), name.alias("name"), plain.alias("plain"), loose.alias("loose")), chosen)

    return let(value, lambda v: let(F.struct(v.alias("raw"), trimmed(F.regexp_replace(v, r"\([^()]*\)", "")).alias("clean")), read))


def decoded_words(text: Column) -> Column:
    """RFC 2047 words in UTF-8 or a single-byte charset decoded; others stay as they are."""
    word = r"=\?[^?]+\?[BQbq]\?[^?]*\?="
    between = F.split(text, word, -1)
    found = F.regexp_extract_all(text, F.lit(word), F.lit(0))

    def one(w: Column) -> Column:
        charset = F.lower(F.regexp_extract(w, r"=\?([^?]+)\?", 1))
        kind = F.upper(F.regexp_extract(w, r"=\?[^?]+\?([BQbq])\?", 1))
        body = F.regexp_extract(w, r"=\?[^?]+\?[BQbq]\?([^?]*)\?=", 1)
        spaced = F.replace(body, F.lit("_"), F.lit(" "))
        tokens = F.regexp_extract_all(spaced, F.lit(r"(?s)=[0-9A-Fa-f]{2}|."), F.lit(0))
        codes = F.transform(tokens, lambda t: F.when(t.rlike("^=[0-9A-Fa-f]{2}"), F.substr(t, F.lit(2))).otherwise(F.hex(F.encode(t, "UTF-8"))))
        raw = F.when(kind == "B", F.try_to_binary(body, F.lit("base64"))).otherwise(F.unhex(F.array_join(codes, "")))
        return F.coalesce(F.when(charset.isin("utf-8", "utf8"), F.make_valid_utf8(raw.cast("string"))).otherwise(charsets.single_byte(raw, charset)), w)

    decoded = F.transform(found, one)
    pieces = F.zip_with(between, decoded, lambda b, d: F.concat(F.coalesce(b, F.lit("")), F.coalesce(d, F.lit(""))))
    return F.when(F.coalesce(text.contains("=?"), F.lit(False)), F.array_join(pieces, "")).otherwise(F.coalesce(text, F.lit("")))


def _subject(h: Column) -> Column:
    return let(first_of(h, "subject"), decoded_words)


def parse_headers(messages: DataFrame) -> DataFrame:
    """messages (msg_id, raw) with one column `headers` of parsed header fields."""
    rows = messages.withColumn("_h", header_lines(F.col("raw")))
    h = F.col("_h")
    rows = rows.withColumns({f"_{key}": address(first_of(h, key)) for key in ("from", "reply-to", "return-path")})
    domains = F.filter(
        F.array(
            *[F.struct(F.lit(label).alias("source"), F.split(F.col(f"`_{key}`")["email"], "@")[1].alias("domain")) for label, key in (("From", "from"), ("Reply-To", "reply-to"), ("Return-Path", "return-path"))]
        ),
        lambda d: d["domain"].isNotNull(),
    )
    duplicated = F.filter(F.array(*[F.struct(F.lit(k).alias("header"), F.size(all_of(h, k)).alias("count")) for k in SINGLE_HEADERS]), lambda d: d["count"] > 1)
    parsed = F.struct(
        F.col("_from").alias("from"), F.col("`_reply-to`").alias("reply_to"), F.col("`_return-path`").alias("return_path"), address(first_of(h, "to")).alias("to"),
        _subject(h).alias("subject"), first_of(h, "date").alias("date"), first_of(h, "message-id").alias("message_id"), all_of(h, "received").alias("received"),
        all_of(h, "authentication-results").alias("authentication_results"), all_of(h, "received-spf").alias("received_spf"), all_of(h, "dkim-signature").alias("dkim_signature"),
        first_of(h, "content-type").alias("content_type"), first_of(h, "x-mailer").alias("x_mailer"), first_of(h, "x-originating-ip").alias("x_originating_ip"),
        F.filter(h, lambda x: F.startswith(x["key"], F.lit("x-"))).alias("x_headers"), h.alias("ordered"), duplicated.alias("duplicated"), domains.alias("domains"),
    )
    return rows.withColumn("headers", parsed).drop("_h", "_from", "_reply-to", "_return-path")


def is_message(headers: Column) -> Column:
    """Whether the parsed headers hold one that only messages have."""
    return F.exists(headers["ordered"], lambda h: h["key"].isin(EMAIL_HEADERS))
