"""MIME bodies: one Arrow pass takes a message apart into its text, HTML and files.

Nesting has no relational form, so each message is walked where it lies; the result is one row per
message, nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import batches as B
from ..functions import htmlscan, urldecode
from ..functions import text as T
from . import containers

# What a page says of itself: a file's, and that of the message's own HTML.
_PAGE = {"login": pa.bool_(), "services": pa.list_(pa.string()), "carried": pa.int32(), "layers": pa.int32(), "smuggling": pa.bool_(), "scripted": pa.bool_()}
_PAGE_KIND = "login:boolean,services:array<string>,carried:int,layers:int,smuggling:boolean,scripted:boolean"
_FILES = pa.list_(pa.struct([("filename", pa.string()), ("content_type", pa.string()), ("size", pa.int64()), ("inline", pa.bool_()), ("bytes", pa.binary()), ("within", pa.string()), *_PAGE.items()]))
_DESTINATIONS = pa.list_(pa.struct([("url", pa.string()), ("kind", pa.string()), ("service", pa.string()), ("within", pa.string()), ("asks", pa.bool_())]))
_WRAPPED = pa.list_(pa.struct([("url", pa.string()), ("destination", pa.string()), ("note", pa.string())]))
#: Bytes of unpacked messages in a batch that leaves a worker, besides the last message's.
OUTPUT_BYTES = 4 << 20
_SCHEMA = (
    f"text string, html string, files array<struct<filename:string,content_type:string,size:bigint,inline:boolean,bytes:binary,within:string,{_PAGE_KIND}>>, "
    f"body_page struct<{_PAGE_KIND}>, destinations array<struct<url:string,kind:string,service:string,within:string,asks:boolean>>, wrapped array<struct<url:string,destination:string,note:string>>"
)

# Extensions of files that are read as pages, uses of an address that plain links and
# images cover already, uses that carry what is typed, and the signs of a page that builds a file.
PAGE_EXTENSIONS = frozenset("htm html shtml xhtml svg hta mht mhtml".split())
COVERED = frozenset(("link", "image", "stylesheet or resource"))
TYPED = frozenset(("form target", "fetch", "XMLHttpRequest", "jQuery request", "beacon", "request URL"))
SMUGGLING = (r"new\s+Blob\s*\(|msSaveOrOpenBlob|createObjectURL", r"download\s*=|\.click\s*\(\)", r"base64,[A-Za-z0-9+/=]{500,}|atob\s*\(")

_URL = re.compile(r"""https?://[^\s<>"')\]]+""", re.I)
_HREF = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["']""", re.I)


def split_head(part: str) -> tuple[str, str]:
    m = re.search(r"\r\n\r\n|\n\n", part)
    return (part[: m.start()], part[m.end() :]) if m else (part, "")


def fields(head: str) -> dict[str, str]:
    """Header fields by lower-case name; the last of equal ones counts."""
    out = {}
    for line in re.split(r"\r?\n", re.sub(r"\r?\n[ \t]+", " ", head)):
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def parameter(value: str, name: str) -> str | None:
    m = re.search(name + r'\s*=\s*"([^"]*)"', value, re.I) or re.search(name + r"\s*=\s*([^;\s]+)", value, re.I)
    return m[1] if m else None


def decoded(body: str, encoding: str) -> bytes:
    raw = body.encode("utf-8", "surrogateescape")
    if encoding == "base64":
        clean = re.sub(rb"[^A-Za-z0-9+/]", b"", raw)
        try:
            return base64.b64decode(clean[: len(clean) - (len(clean) % 4 == 1)] + b"=" * (-len(clean) % 4))
        except binascii.Error:
            return raw
    if encoding == "quoted-printable":
        return re.sub(rb"=([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), re.sub(rb"=\r?\n", b"", raw))
    return raw


def as_text(data: bytes, charset: str) -> str:
    try:
        return data.decode(codecs.lookup(charset).name, "replace")
    except (LookupError, ValueError):
        return data.decode("utf-8", "replace")


def parts_of(body: str, boundary: str) -> list[str]:
    """The parts between boundary lines. A boundary counts at the start of a line alone, whole."""
    line = re.compile(r"(?:\A|\r?\n)--" + re.escape(boundary) + r"(--)?[ \t]*(?=\r?\n|\Z)")
    out, start = [], None
    for m in line.finditer(body):
        if start is not None:
            out.append(re.sub(r"\A\r?\n", "", body[start : m.start()]))
        start = m.end()
        if m[1]:
            return out
    return out if start is None else [*out, re.sub(r"\A\r?\n", "", body[start:])]


def walk(head: str, body: str, out: dict) -> None:
    """Adds the text, HTML and files of a message's parts to out, in order, nested to any depth."""
    waiting = [(head, body, 0)]
    while waiting:
        head, body, depth = waiting.pop()
        waiting += [(*split_head(part), depth + 1) for part in reversed(_add(head, body, out, depth))]


def _add(head: str, body: str, out: dict, depth: int) -> list[str]:
    """Adds a part to out, or returns the parts inside it."""
    own = fields(head)
    kind = own.get("content-type", "text/plain")
    mime = kind.split(";")[0].strip().lower()
    disposition = own.get("content-disposition", "")
    if mime.startswith("multipart/"):
        boundary = parameter(kind, "boundary")
        return parts_of(body, boundary) if boundary else []
    data = decoded(body, own.get("content-transfer-encoding", "7bit").strip().lower())
    name = parameter(disposition, "filename") or parameter(kind, "name")
    content_id = own.get("content-id", "").strip("<> ") or None
    placed = disposition.split(";")[0].strip().lower()
    plain = mime in ("text/html", "text/plain")
    inside = plain and (placed == "inline" or (content_id and not name))
    if placed == "attachment" or mime == "text/calendar" or (not inside and (name or content_id or (depth and not mime.startswith("text/")))):
        ending = re.sub("[^a-z0-9]", "", mime.partition("/")[2] or "bin")
        fallback = f"inline-{content_id}" if content_id else "invite.ics" if mime == "text/calendar" else f"unnamed-part.{ending}"
        out["files"].append({"filename": name or fallback, "content_type": mime, "size": len(data), "inline": placed == "inline" or content_id is not None, "bytes": data})
    elif mime == "text/html":
        out["html"].append(as_text(data, parameter(kind, "charset") or "utf-8"))
    elif mime.startswith("text/"):
        out["text"].append(as_text(data, parameter(kind, "charset") or "utf-8") + "\n")
    return []


def _page(text: str, within: str | None, out: dict, blobs: list[bytes]) -> dict:
    """Reads a page: its traits, with the addresses it sends data to in out."""
    found = htmlscan.inspect(text, blobs)
    for d in found["destinations"]:
        if d["kind"] not in COVERED or d["hidden"]:
            out["destinations"].append({"url": d["url"], "kind": d["kind"], "service": d["service"], "within": within, "asks": found["password_form"] and d["kind"] in TYPED})
    services = list(dict.fromkeys(d["service"] for d in found["destinations"] if d["service"]))
    signs = sum(bool(re.search(sign, text, re.I)) for sign in SMUGGLING)
    named = [p["name"] for p in found["payloads"]]
    return {"login": found["password_form"], "services": services, "carried": len(named), "layers": found["hidden_layers"], "smuggling": signs >= 2, "scripted": "<script" in text.lower(), "names": named}


def read_pages(out: dict) -> None:
    """Reads the message's HTML and the files that are pages. Files that a page carries become files
    of their own; nothing inside those is read again."""
    body = "".join(out["html"])
    out["body_page"] = None
    if body:
        out["body_page"] = _page(body, None, out, [])
    for f in list(out["files"]):
        extension = re.search(r"\.([A-Za-z0-9]+)$", f["filename"])
        if f["bytes"] and (re.search("html|svg", f["content_type"]) or (extension and extension[1].lower() in PAGE_EXTENSIONS)):
            blobs: list[bytes] = []
            page = _page(f["bytes"].decode("utf-8", "replace"), f["filename"], out, blobs)
            f |= page
            for name, blob in zip(page["names"], blobs, strict=True):
                out["files"].append({"filename": name, "content_type": "application/octet-stream", "size": len(blob), "inline": False, "bytes": blob, "within": f["filename"]})


def wrapped_links(out: dict) -> list[dict]:
    """The links of a message that gateways or redirects wrap, with the http(s) address behind."""
    page = "".join(out["html"])
    shown = _URL.findall("".join(out["text"])) + [x.strip() for x in _HREF.findall(page)] + _URL.findall(html.unescape(page)) + [d["url"] for d in out["destinations"]]
    found = []
    for url in dict.fromkeys(shown):
        hit = urldecode.unwrap(url)
        if hit and hit[0] != url and re.match("https?://", hit[0], re.I):
            found.append({"url": url, "destination": hit[0], "note": hit[1]})
    return found


def read_message(raw: str) -> dict:
    """text, html, files, body_page, destinations, wrapped and parse_error of one message. A message
    that can't be read has an error and nothing else."""
    out: dict = {"text": [], "html": [], "files": [], "destinations": [], "parse_error": None}
    try:
        walk(*split_head(raw), out)
        containers.read(out)
        n = len(out["files"])
        read_pages(out)
        containers.read(out, n)
        return out | {"wrapped": wrapped_links(out)}
    except Exception as e:
        return {"text": [], "html": [], "files": [], "destinations": [], "body_page": None, "wrapped": [], "parse_error": f"{type(e).__name__}: {e}"[:200]}


def _size(out: dict) -> int:
    return sum(len(f["bytes"] or b"") for f in out["files"]) + sum(map(len, out["text"])) + sum(map(len, out["html"]))


def parse_bodies(messages: DataFrame) -> DataFrame:
    """messages (msg_id, raw, ...) with body_text, html, links, files, body_page (traits of the HTML
    body), destinations (where pages send data and documents link to), wrapped (links with the address
    behind them) and parse_error (null, or why a message could not be taken apart).

    body_text is the plain text, or the HTML's readable text if there is none. Batches are cut by what
    messages unpack to.
    """
    names = messages.columns
    at = names.index("raw")

    def columns_of(found: list[dict]) -> list[pa.Array]:
        columns = [pa.array(["".join(x["text"]) for x in found], pa.string()), pa.array(["".join(x["html"]) for x in found], pa.string()), pa.array([x["files"] for x in found], _FILES)]
        columns += [pa.array([x["body_page"] for x in found], pa.struct(list(_PAGE.items()))), pa.array([x["destinations"] for x in found], _DESTINATIONS), pa.array([x["wrapped"] for x in found], _WRAPPED)]
        return [*columns, pa.array([x["parse_error"] for x in found], pa.string())]

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in B.slices(whole)):
            found, begin, size = [], 0, 0
            for i in range(batch.num_rows):
                found.append(read_message(batch.column(at)[i].as_py() or ""))
                size += _size(found[-1])
                if size >= OUTPUT_BYTES or i + 1 == batch.num_rows:
                    own = batch.slice(begin, len(found)).columns
                    yield pa.RecordBatch.from_arrays([*own, *columns_of(found)], [*names, "text", "html", "files", "body_page", "destinations", "wrapped", "parse_error"])
                    found, begin, size = [], i + 1, 0

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema) + ", " + _SCHEMA + ", parse_error string"
    rows = messages.mapInArrow(take_apart, schema)
    plain = T.trimmed(F.col("text"))
    rows = rows.withColumn("body_text", F.when(plain != "", plain).otherwise(T.strip_html(F.col("html"))))
    return rows.withColumn("links", T.html_links(F.col("html"))).drop("text")


def with_attached(messages: DataFrame) -> DataFrame:
    """(msg_id, parent_msg_id, raw): messages (msg_id, raw) and all messages attached to them, to any
    depth, each a row of its own. An attached message's id is its parent's, a slash and its place
    among the parent's files; ids become strings, and messages that came in have no parent. Null
    texts stay as they are."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for msg_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, waiting = [], [(msg_id, None, raw)]
                while waiting:
                    own, parent, text = waiting.pop()
                    found.append((own, parent, text))
                    out: dict = {"text": [], "html": [], "files": []}
                    walk(*split_head(text or ""), out)
                    inner = [(f"{own}/{i}", own, as_text(f["bytes"], "utf-8")) for i, f in enumerate(out["files"]) if f["content_type"] == "message/rfc822" or f["filename"].lower().endswith(".eml")]
                    waiting += reversed(inner)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], ["msg_id", "parent_msg_id", "raw"])

    rows = messages.select(F.col("msg_id").cast("string").alias("msg_id"), "raw")
    return rows.mapInArrow(unfold, "msg_id string, parent_msg_id string, raw string")
