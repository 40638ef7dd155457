"""Static reading of HTML: where a page sends data, and what it carries inside itself. Nothing is run.

One Arrow pass over pages: hidden layers are only known once the layer around them is decoded. A page is
read as tags with their attributes, calls with their leading arguments, and assigned names; tables say
which of them use an address, and how. Decoding makes a layer smaller than the text that holds it, so
layers are followed to any depth.
"""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame

#: How a page uses an address, strongest first; the first SENDING of them send data.
KINDS = ("form target", "fetch", "XMLHttpRequest", "jQuery request", "beacon", "WebSocket", "request URL", "redirect", "meta refresh", "external script", "embedded frame", "URL in script", "stylesheet or resource", "image", "link")
SENDING = 7
#: (tag, attribute): kind
ATTRIBUTES = {("form", "action"): "form target", ("script", "src"): "external script", ("iframe", "src"): "embedded frame", ("link", "href"): "stylesheet or resource", ("img", "src"): "image", ("a", "href"): "link"}
#: Last name of a call: (kind, which argument)
CALLS = {"fetch": ("fetch", 0), "sendBeacon": ("beacon", 0), "WebSocket": ("WebSocket", 0), "replace": ("redirect", 0), "assign": ("redirect", 0), "post": ("jQuery request", 0), "get": ("jQuery request", 0), "ajax": ("jQuery request", 0), "open": ("XMLHttpRequest", 1)}
METHODS = {"GET", "POST", "PUT"}
#: Calls whose name must stand behind a receiver of this name.
RECEIVERS = {"replace": "location", "assign": "location", "post": "$", "get": "$", "ajax": "$"}
DECODERS = {"atob", "unescape", "decodeURIComponent", "decodeURI"}
SAVERS = {"saveAs", "msSaveOrOpenBlob"}

# Services that collect stolen data, as (part of the address, name, whether it may be an
# ordinary site and counts only where the page sends data to it).
SERVICES = (
    (r"api\.telegram\.org/bot", "Telegram bot", False), (r"discord(?:app)?\.com/api/webhooks", "Discord webhook", False), (r"hooks\.slack\.com/services", "Slack webhook", False),
    (r"formspree\.io", "Formspree", False), (r"formsubmit\.co", "FormSubmit", False), (r"getform\.io", "Getform", False), (r"submit-form\.com", "Submit-Form", False),
    (r"api\.emailjs\.com", "EmailJS", False), (r"webhook\.site", "webhook.site", False), (r"pipedream\.net", "Pipedream", False), (r"requestbin|\.requestcatcher\.com", "request bin", False),
    (r"script\.google\.com/macros", "Google Apps Script", True), (r"\.ngrok(?:-free)?\.(?:io|app|dev)", "ngrok tunnel", True), (r"\.workers\.dev", "Cloudflare Worker", True),
)

#: Shortest blob that counts, and shortest coded text that is tried: in a data URI, in a call, alone.
LEAST_BYTES, LEAST_URI, LEAST_CALL, LEAST_ALONE = 64, 120, 100, 800

_TAG = re.compile(r"<([a-z][a-z0-9]*)\b([^<>]*)>", re.I)
_ATTRIBUTE = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CALL = re.compile(r"([$\w]+(?:\.[$\w]+)*)\s*\(")
_ARGUMENT = re.compile(r"""\s*(?:"([^"]*)"|'([^']*)'|`([^`]*)`|[^,()"'`]*)\s*(,?)""")
# Looks ahead, so that what stands inside a value is read as well: quotes of a page need not be in step.
_ASSIGNED = re.compile(r"""([\w.]+)\s*[:=]\s*(?=(?:"([^"]*)"|'([^']*)'|`([^`]*)`))""")
_LITERAL = re.compile(r"""["'`](?=(https?:[^\s"'`<>]+)["'`])""", re.I)
_ALONE = re.compile(r"""["'`](?=([A-Za-z0-9+/_-]+={0,2})["'`])""")
_DATA_URI = re.compile(r"data:([a-z0-9.+/-]*)(?:;[a-z0-9=._-]+)*;base64,([A-Za-z0-9+/=\s]+)", re.I)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]+={0,2}\Z")
_CODE = re.compile("%[0-9a-fA-F]{2}")
_ABSOLUTE = re.compile(r"(?:(?:https?|wss?):)?//", re.I)
SCHEMA = "password_form boolean, destinations array<struct<url:string,kind:string,service:string,hidden:boolean>>, payloads array<struct<name:string,size:int,head:string>>, hidden_layers int"


def _first(groups: tuple) -> str | None:
    return next((g for g in groups if g is not None), None)


class _Page:
    """Tags, calls, assignments and quoted texts of one layer."""

    def __init__(self, text: str):
        self.text = text
        self.tags = [(m[1].lower(), {a[1].lower(): _first(a.groups()[1:]) for a in _ATTRIBUTE.finditer(m[2])}) for m in _TAG.finditer(text)]
        self.calls = [(m[1], self._arguments(m.end())) for m in _CALL.finditer(text)]
        self.assigned = [(m[1], _first(m.groups()[1:])) for m in _ASSIGNED.finditer(text)]

    def _arguments(self, at: int) -> list[str | None]:
        """Up to two leading arguments of a call; those that are no plain text are None."""
        out: list[str | None] = []
        while len(out) < 2:
            m = _ARGUMENT.match(self.text, at)
            out.append(_first(m.groups()[:3]))
            if not m[4]:
                break
            at = m.end()
        return out

    def uses(self) -> Iterator[tuple[str, str]]:
        """(kind, address) of everything that uses an address."""
        for tag, own in self.tags:
            for name, value in own.items():
                if (tag, name) in ATTRIBUTES:
                    yield ATTRIBUTES[tag, name], value
            if tag == "meta" and own.get("http-equiv", "").lower() == "refresh":
                yield "meta refresh", own.get("content", "").partition("=")[2].strip(" '\"")
        for name, arguments in self.calls:
            *receiver, last = name.split(".")
            kind, which = CALLS.get(last, ("", 0))
            needed = RECEIVERS.get(last)
            if kind and len(arguments) > which and arguments[which] and (needed is None or (receiver and receiver[-1] == needed)):
                if which == 0 or (receiver and (arguments[0] or "").upper() in METHODS):
                    yield kind, arguments[which]
        for name, value in self.assigned:
            parts = name.split(".")
            if parts[-1] == "url":
                yield "request URL", value
            elif parts[-1] == "location" or parts[-2:] == ["location", "href"]:
                yield "redirect", value
        for value in _LITERAL.findall(self.text):
            yield "URL in script", value

    def asks_password(self) -> bool:
        return any(tag == "input" and own.get("type", "").lower().startswith("password") for tag, own in self.tags)

    def saved_names(self) -> list[str]:
        """Names under which the page saves files."""
        told = [own["download"] for _, own in self.tags if own.get("download")] + [v for n, v in self.assigned if n.split(".")[-1] == "download" and n != "download"]
        told += [a[1] for n, a in self.calls if n.split(".")[-1] in SAVERS and len(a) > 1 and a[1]]
        return [n for n in told if len(n) < 200]

    def carried(self) -> list[bytes]:
        """The decoded blobs of the page, each once."""
        coded = [m[2] for m in _DATA_URI.finditer(self.text) if len(m[2]) >= LEAST_URI and (not m[1].lower().startswith("image/") or "svg" in m[1].lower())]
        out: dict[bytes, None] = {}
        for name, arguments in self.calls:
            value = arguments[0] if name.split(".")[-1] in DECODERS else None
            if not value or len(value) < LEAST_CALL:
                continue
            if name.split(".")[-1] == "atob":
                coded.append(value)
            elif len(codes := _CODE.findall(value)) >= 10 and 20 * len(codes) >= len(value):
                out[unquote_to_bytes(value)] = None
        coded += [v for v in _ALONE.findall(self.text) if len(v) >= LEAST_ALONE]
        found = [blob for c in coded if (blob := _decoded(c)) is not None]
        return [b for b in dict.fromkeys([*found, *out]) if len(b) >= LEAST_BYTES]


def _decoded(coded: str) -> bytes | None:
    clean = "".join(coded.split())
    body = clean.translate(str.maketrans("-_", "+/")).rstrip("=")
    return base64.b64decode(body + "=" * (-len(body) % 4)) if _BASE64.match(clean) and len(body) % 4 != 1 else None


def service_of(url: str, kind: str) -> str | None:
    """The collecting service that an address belongs to."""
    sends = KINDS.index(kind) < SENDING
    return next((name for part, name, ordinary in SERVICES if (sends or not ordinary) and re.search(part, url, re.I)), None)


def readable(data: bytes) -> str | None:
    """The text of a blob, or None if over a tenth of it is control characters or no UTF-8."""
    text = data.decode("utf-8", "replace")
    odd = len(re.findall("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f�]", text))
    return text if 10 * odd <= len(text) else None


def is_markup(text: str) -> bool:
    page = _Page(text)
    return any(tag in ("html", "form", "input", "script", "body", "div") for tag, _ in page.tags) or any(kind in KINDS[:8] for kind, _ in page.uses()) or "XMLHttpRequest" in text


def inspect(html: str | None, blobs: list[bytes] | None = None) -> dict:
    """What a page would do if it were opened: see SCHEMA. An address has its strongest use; those of
    hidden layers come after the page's own. The bytes of the payloads are added to blobs."""
    form, found, payloads, saved, layers = False, {}, [], [], 0
    waiting = deque([(html or "", False)])
    while waiting:
        text, hidden = waiting.popleft()
        page = _Page(text)
        form |= page.asks_password()
        saved += page.saved_names()
        for kind, url in sorted(page.uses(), key=lambda use: KINDS.index(use[0])):
            url = url.strip().replace("&amp;", "&")
            if _ABSOLUTE.match(url):
                url = "https:" + url if url.startswith("//") else url
                found.setdefault(url, {"url": url, "kind": kind, "service": service_of(url, kind), "hidden": hidden})
        for blob in page.carried():
            inner = readable(blob)
            if inner is None:
                payloads.append(blob)
            elif is_markup(inner):
                layers += 1
                waiting.append((inner, True))
    if blobs is not None:
        blobs += payloads
    named = [{"name": saved[min(i, len(saved) - 1)] if saved else f"embedded-{i + 1}", "size": len(b), "head": b[:8].hex()} for i, b in enumerate(payloads)]
    return {"password_form": form, "destinations": list(found.values()), "payloads": named, "hidden_layers": layers}


def inspected(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, password_form, destinations, payloads, hidden_layers) of each page; null pages are empty."""
    kinds = {"password_form": pa.bool_(), "destinations": pa.list_(pa.struct([("url", pa.string()), ("kind", pa.string()), ("service", pa.string()), ("hidden", pa.bool_())])), "payloads": pa.list_(pa.struct([("name", pa.string()), ("size", pa.int32()), ("head", pa.string())])), "hidden_layers": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [inspect(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[c] for r in rows], t) for c, t in kinds.items())], [key, *kinds])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, {SCHEMA}")
