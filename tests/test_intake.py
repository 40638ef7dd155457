"""Message files, errors as rows, deceptive links."""

import os

import pytest
from pyspark.sql import functions as F

from mailtriage.plans import triage
from mailtriage.sources import mailsource, mime
from mailtriage.sources import messages as M

from .samples import CLEAN, NO_MESSAGE


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("mail")
    (top / "inner").mkdir()
    for name, content in {"a.eml": CLEAN.encode(), "b.TXT": NO_MESSAGE.encode(), "inner/c.eml": b" \r\n", "d.msg": b"x", "e.eml": bytes.fromhex("D0CF11E0A1B11AE1") + b"x", ".f.eml": b"x", "g.eml": "From: <é@b.cd>\n\nü".encode("latin-1"), "h.eml": b"y" * 5000}.items():
        (top / name).write_bytes(content)
    return str(top)


def test_files_and_errors(spark, folder):
    rows = {r.name: r for r in mailsource.read(spark, folder, maxMessageBytes="4000").collect()}
    assert set(rows) == {"a.eml", "b.TXT", "c.eml", "e.eml", "g.eml", "h.eml"}
    assert {n: r.error for n, r in rows.items() if r.error} == {"c.eml": "empty", "e.eml": "Outlook file", "h.eml": "larger than 4000 bytes"}
    assert bytes(rows["a.eml"].content) == CLEAN.encode() and all((r.content is None) == (r.error is not None) for r in rows.values())
    whole = M.with_raw(M.read_messages(spark, folder))
    reasons = {r.reason for r in triage.rejects(whole).collect()}
    assert reasons == {"empty", "Outlook file", "no message header"} and triage.rejects(whole).count() == 4
    assert {r.name for r in triage.analyze(whole).select("name").collect()} == {"a.eml", "g.eml"}


def test_one_file_and_no_folder(spark, folder):
    assert [r.name for r in mailsource.read(spark, f"file://{folder}/a.eml").collect()] == ["a.eml"]
    with pytest.raises(Exception, match="no such folder"):
        mailsource.read(spark, folder + "/none").collect()
    os.makedirs(folder + "/empty", exist_ok=True)
    assert mailsource.read(spark, folder + "/empty").count() == 0


def test_unreadable_file_is_a_row(tmp_path):
    system, _ = mailsource.opened(str(tmp_path))
    assert mailsource._content(system, str(tmp_path / "gone.eml"), 10, 100) == (None, "unreadable: FileNotFoundError")


def test_shares():
    files = [(str(i), size) for i, size in enumerate([10, 20, 500, 5, 5, 5])]
    cut = [[s for _, s in x.files] for x in mailsource.shares(files, 3 * mailsource.OPEN_BYTES)]
    assert sum(cut, []) == [10, 20, 500, 5, 5, 5] and all(len(c) <= 2 for c in cut)
    assert [len(x.files) for x in mailsource.shares([("a", 1 << 40), ("b", 1)], 1 << 20)] == [1, 1]


def test_many_small_files_share_a_partition(spark, folder):
    assert mailsource.read(spark, folder).rdd.getNumPartitions() == 1
    assert mailsource.read(spark, folder, maxPartitionBytes="70000").rdd.getNumPartitions() == 6


def test_sink(spark, tmp_path):
    rows = spark.createDataFrame([("a.eml", b"one"), ("b.eml", None)], "name string, content binary")
    mailsource.write(rows, f"file://{tmp_path}/out")
    mailsource.write(rows, f"file://{tmp_path}/out")
    assert sorted(os.listdir(tmp_path / "out")) == ["a.eml", "b.eml"] and (tmp_path / "out/a.eml").read_bytes() == b"one"
    for bad in ("../x.eml", "", ".x"):
        with pytest.raises(Exception, match="no name"):
            mailsource.write(spark.createDataFrame([(bad, b"")], "name string, content binary"), f"{tmp_path}/out")


def test_message_kind(spark):
    texts = [("From: a\n\nbody", "full"), ("From: a\r\n\r\nbody", "full"), ("From: a\nTo: b", "headers"), ("x" * 60 + "\n" + "y " * 40, "full"), ("From: a\n " + "z" * 80, "headers"), ("", "headers"), (None, None)]
    rows = spark.createDataFrame(texts, "raw string, want string")
    assert all(r.kind == r.want for r in rows.withColumn("kind", M.message_kind(F.col("raw"))).collect())


def test_a_message_that_breaks_is_a_row(monkeypatch):
    monkeypatch.setattr(mime, "walk", lambda *_: 1 / 0)
    out = mime.read_message(CLEAN)
    assert out["parse_error"].startswith("ZeroDivisionError") and out["files"] == [] and out["wrapped"] == []


def test_batches_are_cut_by_bytes(spark):
    raw = "From: <a@b.test>\nContent-Type: text/plain\n\n" + "x" * 9_000_000
    rows = spark.createDataFrame([(i, raw, i * 2) for i in range(9)], "msg_id int, raw string, extra int").coalesce(1)
    found = mime.parse_bodies(rows).select("msg_id", "extra", F.length("body_text").alias("n"), "parse_error").collect()
    assert sorted((r.msg_id, r.extra, r.n, r.parse_error) for r in found) == [(i, 2 * i, 9_000_000, None) for i in range(9)]


def test_rewritten_links(spark):
    wrap = "https://eur01.safelinks.protection.outlook.com/?url="
    shown = "https://bank.example.com/login"
    cases = [(shown, False), (wrap + "https%3A%2F%2Fbank.example.com%2Flogin", False), (wrap + "https%3A%2F%2Fevil.test%2F", True), ("https://evil.test/", True)]
    rows = spark.createDataFrame([(i, f'From: <a@b.cd>\nContent-Type: text/html\n\n<a href="{href}">{shown}</a>') for i, (href, _) in enumerate(cases)], "msg_id int, raw string")
    found = {r.msg_id: r for r in triage.analyze(rows).select("msg_id", F.exists("iocs.urls", lambda u: u["mismatch"]).alias("m")).collect()}
    assert [found[i].m for i in range(len(cases))] == [want for _, want in cases]
