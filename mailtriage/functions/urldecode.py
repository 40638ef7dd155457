"""Decoders that show where a wrapped or encoded link leads. Nothing is fetched.

Each decoder takes a URL and returns (output, note) or None. They work on single strings, because
the number of layers is only known while decoding; decode() runs them over the distinct URLs of a
table in Arrow batches.
"""

from __future__ import annotations

import base64
import html
import re
from collections.abc import Iterator
from urllib.parse import parse_qsl, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYERS = 5

#: Gateways that carry the destination in a parameter: (host pattern, path pattern, parameters, name).
GATEWAYS = (
    (r"safelinks\.protection\.outlook\.com$", r"", ("url",), "Microsoft Defender Safe Links"),
    (r"(^|\.)google\.[a-z.]+$", r"^/url$", ("q", "url"), "Google redirect"),
    (r"^lm?\.facebook\.com$", r"^/l\.php$", ("u",), "Facebook link shim"),
    (r"^linkprotect\.cudasvc\.com$", r"", ("a",), "Barracuda Link Protection"),
)
#: The run lengths of Proofpoint v3 start at 2 and follow this alphabet.
RUNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"


def _parts(url: str):
    try:
        u = urlsplit(url.strip())
        return u if u.scheme and u.hostname else None
    except ValueError:
        return None


def _strict(text: str) -> str | None:
    """Percent-decoded text, or None if its bytes are no UTF-8."""
    try:
        return unquote(text, errors="strict")
    except UnicodeDecodeError:
        return None


def percent(url: str):
    """Up to five layers of percent-encoding; bytes that are no UTF-8 are taken as Latin-1."""
    layers = 0
    while layers < LAYERS and re.search("%[0-9a-fA-F]{2}", url):
        inner = _strict(url)
        if inner is None:
            inner = unquote(url, "latin-1")
        if inner == url:
            break
        url, layers = inner, layers + 1
    return (url, f"{layers} layers of encoding" if layers > 1 else None) if layers else None


def _bytes64(token: str) -> bytes | None:
    body = token.translate(str.maketrans("-_", "+/")).rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except ValueError:
        return None


def _readable(data: bytes) -> str | None:
    """Text that is nearly all printable and has three letters in a row."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    shown = sum(c >= " " and not "\x7f" <= c < "\xa0" for c in text)
    return text if len(text) >= 4 and shown >= 0.95 * len(text) and re.search("[A-Za-z]{3}", text) else None


def proofpoint_v3(url: str) -> str | None:
    """Restores the characters that were taken out: a star stands for one, two stars and a letter for a run."""
    m = re.search(r"v3/__(.+?)__;(.*?)!", url)
    if not m:
        return None
    data = _bytes64(m[2]) if m[2] else b""
    if data is None:
        return None
    taken = iter(data.decode("utf-8", "replace"))

    def back(t: re.Match) -> str:
        if t[1] is None:
            return next(taken, "*")
        return "".join(c for _, c in zip(range(RUNS.find(t[1]) + 2), taken, strict=False))

    return re.sub(r"\*\*(.)|\*", back, _strict(m[1]) or m[1])


def _step(url: str):
    """(destination, gateway, final note) of one wrapping, or None."""
    u = _parts(url)
    if not u:
        return None
    host, query = u.hostname.lower(), parse_qsl(u.query)

    def of(*names: str) -> str | None:
        return next((v for n in names for k, v in query if k == n and v), None)

    for hosts, paths, names, label in GATEWAYS:
        if re.search(hosts, host) and re.search(paths, u.path) and of(*names):
            return of(*names), label, None
    if host == "urldefense.com" and u.path.startswith("/v3/__") and (found := proofpoint_v3(url)):
        return found, "Proofpoint URL Defense v3", None
    if host.endswith("urldefense.proofpoint.com") and (raw := of("u")):
        if u.path.startswith("/v2/"):
            raw = raw.replace("-", "%").replace("_", "/")
            return _strict(raw) or raw, "Proofpoint URL Defense v2", None
        if u.path.startswith("/v1/"):
            return _strict(raw) or raw, "Proofpoint URL Defense v1", None
    if host == "secure-web.cisco.com" and re.match("https?://", last := unquote(u.path.rpartition("/")[2]), re.I):
        return last, "Cisco Secure Email", None
    if re.search(r"(^|\.)mimecast\.com$", host) and "/s/" in u.path:
        return url, "Mimecast URL Protect", "The destination is held by the gateway and is not in the link."
    for key, value in query:
        if re.match(r"https?://|www\.", value.strip(), re.I) and value.strip() != url:
            return value.strip(), f'redirect parameter "{key}" on {host}', None
    return None


def unwrap(url: str):
    """The destination behind up to five gateways or redirects."""
    chain, now, final = [], url, None
    for _ in range(LAYERS):
        step = _step(now)
        if not step:
            break
        now, label, final = step
        chain.append(label)
        if final:
            break
    if not chain:
        return None
    names = " → ".join(chain)
    return now, f"{names}. {final}" if final else f"Unwrapped: {names}"


def base64_tokens(url: str):
    """Base64 tokens that read as text, e.g. the address of the person a link was made for."""
    text = (percent(url) or (url,))[0]
    tokens = [t for t in re.split(r"[/?&=#;,:.]+", text) if len(t) >= 8 and re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", t) and (re.search(r"\d", t) or re.search("[A-Z].*[a-z]|[a-z].*[A-Z]", t))]
    found = [(t, r) for t in dict.fromkeys(tokens) if (d := _bytes64(t)) and (r := _readable(d))]
    note = "An e-mail address is hidden in the link" if any("@" in r for _, r in found) else None
    return ("\n".join(f"{t}  →  {r}" for t, r in found), note) if found else None


def hex_runs(url: str):
    text = (percent(url) or (url,))[0]
    found = [(t, r) for t in dict.fromkeys(re.findall("(?:[0-9a-fA-F]{2}){6,}", text)) if (r := _readable(bytes.fromhex(t)))]
    return ("\n".join(f"{t}  →  {r}" for t, r in found), None) if found else None


def entities(url: str):
    out = html.unescape(url) if re.search(r"&(#x?[0-9a-fA-F]+|[A-Za-z]+);", url) else url
    return (out, None) if out != url else None


def escapes(url: str):
    r"""\u{1F600}, \u0041 and \x41."""
    out = re.sub(r"\\u\{([0-9a-fA-F]{1,6})\}|\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", lambda m: chr(min(int(m[1] or m[2] or m[3], 16), 0x10FFFF)), url)
    out = out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # pairs become one character
    return (out, None) if out != url else None


def punycode(url: str):
    """The letters that an xn-- host shows."""
    u = _parts(url)
    if not u or not re.search(r"(^|\.)xn--", u.hostname, re.I):
        return None
    try:
        host = ".".join(p[4:].encode().decode("punycode") if p.startswith("xn--") else p for p in u.hostname.lower().split("."))
    except UnicodeError:
        return None
    codes = ", ".join(f"{c} U+{ord(c):04X}" for c in dict.fromkeys(host) if c > "\x7f")
    shown = re.sub(re.escape(u.hostname), lambda _: host, url, count=1, flags=re.I)
    return shown, f"Displays as {host}" + (f" — non-ASCII characters: {codes}" if codes else "")


def everything(url: str):
    """All reversible layers until nothing changes, then what is hidden inside."""
    steps, now = [], url
    for _ in range(LAYERS):
        before = now
        for name, f in (("unwrap", unwrap), ("HTML entities", entities), ("escapes", escapes), ("URL %XX", percent)):
            r = f(now)
            if r and r[0] != now:
                steps.append(r[1].replace("Unwrapped: ", "unwrap: ") if name == "unwrap" else name)
                now = r[0]
        if now == before:
            break
    extra = [f"{label}:\n{r[0]}" for label, f in (("Base64 inside", base64_tokens), ("Hex inside", hex_runs)) if (r := f(now))]
    if r := punycode(now):
        extra.append(r[1])
    return ("\n\n".join([now, *extra]), "Applied: " + " → ".join(steps) if steps else None) if steps or extra else None


DECODERS = {"all": everything, "unwrap": unwrap, "percent": percent, "base64": base64_tokens, "punycode": punycode, "html": entities, "hex": hex_runs, "escape": escapes}


def decode(urls: DataFrame) -> DataFrame:
    """urls (url) to (url, decoder, output, note), a row for each distinct URL and decoder that finds something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(url, name, *r) for url in batch.column(0).to_pylist() for name, f in DECODERS.items() if (r := f(url))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["url", "decoder", "output", "note"])

    return urls.select("url").where("url is not null").distinct().mapInArrow(run, "url string, decoder string, output string, note string")


def destinations(urls: DataFrame) -> DataFrame:
    """(url, destination, note): wrapped links with the http(s) target behind them."""
    found = decode(urls).where("decoder = 'unwrap'").select("url", F.col("output").alias("destination"), "note")
    return found.where(F.col("destination").rlike(r"(?i)\Ahttps?://") & (F.col("destination") != F.col("url")))
