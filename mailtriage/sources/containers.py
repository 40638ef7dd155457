"""What is inside a message's files: archives, office documents, PDF, RTF and calendars.

Runs inside the MIME pass, on one message at a time. Files in archives become files of the message,
with the archive's name as `within`, and are judged like any other; addresses in documents join the
destinations that pages have. All names in an archive count; contents are read within BUDGET bytes a
message, ENTRY bytes a file and DEPTH archives inside each other. A file beyond these, or one that is
encrypted or damaged, has its name and size but null bytes, so that no digest stands for a part of it.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

DEPTH, ENTRY, BUDGET = 2, 25 << 20, 60 << 20

# Marks of the formats.
OFFICE_LIST, MACROS = "[Content_Types].xml", "vbaproject.bin"
EMBEDDED = re.compile(r"/(?:embeddings|activeX)/", re.I)
_RELATION = re.compile(r"<Relationship\b[^>]*>", re.I)
_TARGET = re.compile(r"""\bTarget\s*=\s*["']([^"']+)["']""", re.I)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_PDF_LITERAL = re.compile(rb"/URI\s*\(((?:\\.|[^\\()])*)\)", re.S)
_PDF_HEX = re.compile(rb"/URI\s*<([0-9A-Fa-f\s]*)>")
_RTF_LINK = re.compile(r"""(?:HYPERLINK\s+"?|\\\*\\template\s+)(https?://[^\s"{}\\]+)""", re.I)
_ADDRESS = re.compile(r"""https?://[^\s<>"'\;,)]+""", re.I)


def addresses(texts: Iterator[str]) -> list[str]:
    """The distinct http(s) addresses among texts, in order."""
    return list(dict.fromkeys(t for t in texts if re.match("https?://", t, re.I)))


def entries(data: bytes, budget: int) -> list[tuple[str, int, bytes | None]] | None:
    """(path, size, bytes) of the files in a ZIP, or None if it can't be read as one."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError, UnicodeDecodeError):
        return None
    found = []
    for info in archive.infolist():
        if info.is_dir():
            continue
        content = None
        limit = min(ENTRY, budget)
        if not info.flag_bits & 1 and info.file_size <= limit:
            try:
                with archive.open(info) as f:
                    content = f.read(limit + 1)
            except (zipfile.BadZipFile, zlib.error, OSError, EOFError, ValueError, NotImplementedError, RuntimeError):
                content = None
            if content is not None and len(content) > limit:
                content = None
        budget -= len(content or b"")
        found.append((info.filename, info.file_size, content))
    return found


def office_links(parts: list[tuple[str, int, bytes | None]]) -> list[str]:
    """External targets of an office document's relations: links, templates, pictures."""
    targets = []
    for path, _, content in parts:
        if content and path.lower().endswith(".rels"):
            for tag in _RELATION.findall(content.decode("utf-8", "replace")):
                if re.search(r"""TargetMode\s*=\s*["']External""", tag, re.I):
                    targets += [t.replace("&amp;", "&") for t in _TARGET.findall(tag)]
    return addresses(targets)


def pdf_parts(data: bytes) -> list[bytes]:
    """The PDF itself and its deflated streams; the streams share ENTRY bytes."""
    out, left = [data], ENTRY
    for m in _STREAM.finditer(data):
        if left > 0:
            try:
                plain = zlib.decompressobj().decompress(m[1], left)
            except zlib.error:
                continue
            left -= len(plain)
            out.append(plain)
    return out


def pdf_links(parts: list[bytes]) -> list[str]:
    found = []
    for part in parts:
        found += [re.sub(rb"\\(.)", rb"\1", x, flags=re.S).decode("latin-1") for x in _PDF_LITERAL.findall(part)]
        for x in _PDF_HEX.findall(part):
            digits = re.sub(rb"\s", b"", x)
            found.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1"))
    return addresses(found)


def names_of(part: bytes) -> bytes:
    """A PDF part with escapes in names undone."""
    return re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), part)


def read(out: dict, first: int = 0) -> None:
    """Opens the files of out from place `first` on; adds files and destinations to out."""
    left = BUDGET - sum(len(f["bytes"] or b"") for f in out["files"] if f.get("within"))
    waiting = [(f, 0) for f in out["files"][first:]]
    for f, depth in waiting:  # grows as archives are opened
        data, name = f["bytes"] or b"", f["filename"]
        links: list[str] = []
        kind = "document link"
        if data[:4] == b"PK\3\4" and depth < DEPTH:
            parts = entries(data, max(0, left)) or []
            office = any(path == OFFICE_LIST for path, _, _ in parts)
            if office:
                links = office_links(parts)
                f["scripted"] = bool(f.get("scripted")) or any(path.lower().endswith(MACROS) for path, _, _ in parts)
                parts = [p for p in parts if EMBEDDED.search(p[0])]
            for path, size, content in parts:
                left -= len(content or b"")
                inner = {"filename": path.rsplit("/", 1)[-1], "content_type": "application/octet-stream", "size": size, "inline": False, "bytes": content, "within": name}
                out["files"].append(inner)
                waiting.append((inner, depth + 1))
        elif b"%PDF-" in data[:1024]:
            parts = pdf_parts(data)
            links = pdf_links(parts)
            f["scripted"] = any(re.search(rb"/(?:JavaScript|JS|Launch)\b", names_of(p)) for p in parts)
        elif data[:5] == b"{\\rtf":
            links = addresses(_RTF_LINK.findall(data.decode("latin-1")))
        elif f["content_type"] == "text/calendar" or name.lower().endswith(".ics"):
            links = addresses(_ADDRESS.findall(re.sub(r"\r?\n[ \t]", "", data.decode("utf-8", "replace"))))
            kind = "calendar link"
        out["destinations"] += [{"url": url, "kind": kind, "service": None, "within": name, "asks": False} for url in links]
