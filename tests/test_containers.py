"""Archives, office documents, PDF, RTF and calendars inside messages."""

import base64
import io
import random
import zipfile
import zlib

import pytest

from mailtriage.plans import triage
from mailtriage.sources import containers

from .samples import CLEAN

RELATIONS = '<Relationships><Relationship Id="1" Type="x/attachedTemplate" Target="https://evil.test/t.dotm?a=1&amp;b=2" TargetMode="External"/><Relationship Id="2" Target="media/image1.png"/></Relationships>'


def zipped(**files) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return buffer.getvalue()


PROGRAM = b"MZ" + b"\1" * 200
ARCHIVE = zipped(**{"docs/readme.txt": b"hello", "docs/invoice.pdf.exe": PROGRAM, "inner.zip": zipped(**{"deep.js": b"var a"})})
OFFICE = zipped(**{"[Content_Types].xml": b"<Types/>", "word/_rels/settings.xml.rels": RELATIONS.encode(), "word/vbaProject.bin": b"x", "word/embeddings/o.bin": PROGRAM})
STREAM = zlib.compress(b"<< /Type /Annot /URI (https://evil.test/a\\)b) >> << /S /JavaScr#69pt >>")
PDF = b"%PDF-1.4\n<< /URI <68747470733a2f2f6578616d706c652e746573742f78> >>\nstream\n" + STREAM + b"\nendstream\n"
RTF = b'{\\rtf1 {\\field{\\*\\fldinst HYPERLINK "https://evil.test/rtf"}}}'
ICS = b"BEGIN:VCALENDAR\r\nDESCRIPTION:join https://evil.test/mee\r\n ting now\r\nEND:VCALENDAR\r\n"


def holding(name: str, data: bytes) -> str:
    head, _, body = CLEAN.partition("\n\n")
    head = head.replace("Content-Type: text/plain; charset=utf-8", 'MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="q"')
    return f'{head}\n\n--q\nContent-Type: text/plain\n\n{body}\n--q\nContent-Type: application/octet-stream; name="{name}"\nContent-Disposition: attachment; filename="{name}"\nContent-Transfer-Encoding: base64\n\n{base64.b64encode(data).decode()}\n--q--\n'


FILES = {"a.zip": ARCHIVE, "a.docx": OFFICE, "a.pdf": PDF, "a.rtf": RTF, "a.ics": ICS, "plain.zip": zipped(**{"note.txt": b"hello"})}


@pytest.fixture(scope="module")
def by(spark):
    rows = spark.createDataFrame([(name, holding(name, data)) for name, data in FILES.items()], "msg_id string, raw string")
    return {r.msg_id: r for r in triage.analyze(rows.repartition(2)).select("msg_id", "tier", "iocs", "files", "file_risks").collect()}


def risks(row):
    return {f.value: [r.type for r in f.risks] for f in row.file_risks}


def test_archives(by):
    found = {f.filename: f.within for f in by["a.zip"].files}
    assert found == {"a.zip": None, "readme.txt": "a.zip", "invoice.pdf.exe": "a.zip", "inner.zip": "a.zip", "deep.js": "inner.zip"}
    assert {"double-extension", "executable-content", "risky-extension"} <= set(risks(by["a.zip"])["invoice.pdf.exe"]) and "risky-extension" in risks(by["a.zip"])["deep.js"]
    assert by["a.zip"].tier == "High Risk" and by["plain.zip"].tier == "Low Risk"


def test_documents(by):
    urls = {name: {u.value for u in row.iocs.urls} for name, row in by.items()}
    assert "https://evil.test/t.dotm?a=1&b=2" in urls["a.docx"] and "executable-content" in risks(by["a.docx"])["o.bin"] and "scripted-page" in risks(by["a.docx"])["a.docx"]
    assert {"https://evil.test/a)b", "https://example.test/x"} <= urls["a.pdf"] and "scripted-page" in risks(by["a.pdf"])["a.pdf"]
    assert "https://evil.test/rtf" in urls["a.rtf"] and "https://evil.test/meeting" in urls["a.ics"]


def opened(data: bytes, name: str = "x.zip") -> dict:
    out = {"files": [{"filename": name, "content_type": "application/zip", "bytes": data}], "destinations": []}
    containers.read(out)
    return out


def test_limits(monkeypatch):
    monkeypatch.setattr(containers, "BUDGET", 1000)
    held = {f["filename"]: f["bytes"] for f in opened(zipped(**{f"f{i}": bytes(400) for i in range(5)}))["files"][1:]}
    assert len(held) == 5 and [held[f"f{i}"] is None for i in range(5)] == [False, False, True, True, True]
    nested = zipped(a=zipped(b=zipped(c=b"x")))
    assert [f["filename"] for f in opened(nested)["files"]] == ["x.zip", "a", "b"]


def test_encrypted_and_damaged():
    locked = bytearray(zipped(secret=b"text"))
    locked[6] |= 1
    at = bytes(locked).index(b"PK\1\2")
    locked[at + 8] |= 1
    assert [(f["filename"], f["bytes"]) for f in opened(bytes(locked))["files"][1:]] == [("secret", None)]
    rng = random.Random(3)
    for seed in (ARCHIVE, OFFICE, PDF, RTF, ICS):
        for _ in range(150):
            b = bytearray(seed)
            for _ in range(rng.randint(1, 8)):
                b[rng.randrange(len(b))] = rng.randrange(256)
            opened(bytes(b[: rng.randint(4, len(b))]))
    assert len(opened(b"")["files"]) == 1
