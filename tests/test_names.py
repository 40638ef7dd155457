"""File names, domain lists, DOS times, passwords, summaries."""

import datetime
import unicodedata

from pyspark.sql import functions as F

from mailtriage.functions import names
from mailtriage.operators import summary
from mailtriage.plans import triage

from .samples import CLEAN, FAKE, NO_MESSAGE, WIRE
from .test_forms import column


def test_safe_filename(spark):
    plain = {"a/b\\c:d.pdf": "a_b_c_d.pdf", " ..x.txt. ": "x.txt", "a\x00\tb": "ab", "": "file", None: "file", "...": "file", "x" * 300: "x" * 180, "Größe.doc": "Größe.doc"}
    assert column(spark, list(plain), names.safe_filename) == list(plain.values())
    raw = {"a.EXE": "a.EXE.bin", "a.pdf": "a.pdf", "noending": "noending.bin", None: "file.bin", "a.docm": "a.docm.bin"}
    assert column(spark, list(raw), lambda c: names.safe_filename(c, raw=True)) == list(raw.values())
    assert column(spark, ["a.pdf"], lambda c: names.safe_filename(c, raw=True, program=F.lit(True))) == ["a.pdf.bin"]
    assert column(spark, ["x.Js", "x", None, "x.js.txt", "x.url"], names.executable_name) == [True, False, False, False, True]


def test_report_filename(spark):
    def plain(subject):
        slug = "".join(c for c in unicodedata.normalize("NFKD", subject or "") if c < "\x80").lower()
        words = [w for w in "".join(c if c.isalnum() else " " for c in slug).split()]
        full = "-".join(words)
        short = full[:40]
        if len(full) > 40 and "-" in short:
            short = short.rsplit("-", 1)[0]
        return f"phishing-report_2026-09-17_{short or 'email'}.html"

    subjects = ["Account suspended!", None, "", "Ünïcödé ﬁle ½ № ™", "你好", "x" * 60, "one two three four five six seven eight nine ten eleven", "ＦＵＬＬ width", "--a--", "Œuvre Å ⓐ ㎏"]
    subjects.append("a" * 39 + " b")
    got = column(spark, subjects, lambda c: names.report_filename(c, F.lit("2026-09-17").cast("date"), "html"))
    assert got == [plain(s) for s in subjects]


def test_domain_list(spark):
    lists = {
        "Example.com, www.test.org;https://u@corp.net/path\nann@mail.example.co.uk": (["example.com", "test.org", "corp.net", "mail.example.co.uk"], []),
        "a.com b.org  c.net": (["a.com", "b.org", "c.net"], []), "not a domain": ([], ["not a domain"]), "a.com,a.com.,localhost,-x.com, x-.com": (["a.com"], ["localhost", "-x.com", "x-.com"]),
        "": ([], []), None: ([], []), " , ;\n": ([], []), "x" * 64 + ".com": ([], ["x" * 64 + ".com"]), "x" * 63 + ".com": (["x" * 63 + ".com"], []), "sub.a.com?q=1#f": (["sub.a.com"], []),
    }
    assert [(r.valid, r.invalid) for r in column(spark, list(lists), names.domain_list)] == list(lists.values())


def test_dos_time(spark):
    at = datetime.datetime(2024, 1, 15, 13, 45, 31)
    (r,) = column(spark, [at], lambda c: names.dos_time(c), "timestamp")
    assert (r.time, r.day) == ((13 << 11) | (45 << 5) | 15, (44 << 9) | (1 << 5) | 15)
    assert column(spark, [at], lambda c: names.from_dos_time(names.dos_time(c)["time"], names.dos_time(c)["day"]), "timestamp") == [at.replace(second=30)]
    assert column(spark, [0], lambda c: names.from_dos_time(c, c), "int") == [None]


def test_said_passwords(spark):
    texts = {
        "The password is: 7731.": ["7731"], "Pwd - Inv2024, thanks": ["Inv2024"], "password for the archive: «Geheim9»": ["Geheim9"], "Your password is required. Password reset here": [],
        "Kennwort: Haus#1\nmot de passe : chat22": ["Haus#1", "chat22"], "Contraseña: sol99 пароль: Лето2024": ["sol99", "Лето2024"], "password=ab": ["=ab"], "pw: a": [], "password: x1y password: x1y": ["x1y"],
        " ".join(f"pw: key{i:02d}" for i in range(12)): [f"key{i:02d}" for i in range(10)], None: [], "": [], "mypassword: abc123": [],
    }
    assert column(spark, list(texts), names.said_passwords) == list(texts.values())


def test_revealed(spark):
    assert column(spark, ["invoice‮fdp.exe", "a؜b⁩", "plain", None], names.revealed) == ["invoice[U+202E RLO]fdp.exe", "a[U+061C ALM]b[U+2069 PDI]", "plain", ""]


def test_summaries(spark):
    raw = spark.createDataFrame([("clean", CLEAN), ("fake", FAKE), ("wire", WIRE), ("none", NO_MESSAGE)], "msg_id string, raw string")
    analyzed = triage.analyze(raw)
    rows = {r.msg_id: r for r in summary.summary_rows(analyzed, triage.rejects(raw)).collect()}
    assert set(rows) == {"clean", "fake", "wire", "none"}
    assert rows["none"].error == "no message header" and rows["none"].tier is None
    assert rows["fake"].sender == "security@paypa1.com" and rows["fake"].subject == "Invoice 4021 overdue" and rows["fake"].tier == "High Risk" and rows["fake"].top
    assert rows["clean"].error is None and rows["clean"].score < 30

    found = {r.msg_id: r for r in analyzed.select("msg_id", summary.indicator_list().alias("safe"), summary.indicator_list(raw=True).alias("raw"), summary.wording_sentence(F.col("hits")).alias("said"), summary.some_names(F.col("iocs.urls")).alias("links")).collect()}
    safe, plain = found["fake"].safe.split("\n"), found["fake"].raw.split("\n")
    assert safe[0] == "# URLs" and "hxxp[://]paypa1-verify[.]top/login" in safe and "http://paypa1-verify.top/login" in plain
    assert [x for x in plain if x.startswith("# ")] == [x for x in safe if x.startswith("# ")]
    assert plain[-3] == "# File hashes" and len(plain[-2]) == 64 and len(plain[-1]) == 32 and "" in plain
    assert "http://paypa1-verify.top/login" in found["fake"].links
    assert found["wire"].said.startswith("Detected: ") and "payment fraud phrase" in found["wire"].said
    assert found["clean"].said.startswith("No suspicious phrases detected.")
