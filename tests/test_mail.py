"""The mail pipeline on messages written for it."""

import pytest
from pyspark.sql import functions as F

from mailtriage.functions import net, text
from mailtriage.operators import auth, correlate, language, score
from mailtriage.plans import triage
from mailtriage.sources import messages as M
from mailtriage.sources import mime

from .samples import CLEAN, FAKE, NO_MESSAGE, TWIN, WIRE


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


@pytest.fixture(scope="module")
def analyzed(spark):
    rows = [("clean", CLEAN), ("fake", FAKE), ("twin", TWIN), ("wire", WIRE), ("crlf", CLEAN.replace("\n", "\r\n")), ("none", NO_MESSAGE)]
    found = triage.analyze(spark.createDataFrame(rows, "msg_id string, raw string").repartition(3)).cache()
    return found, {r.msg_id: r for r in found.collect()}


def test_rejects_what_is_no_message(analyzed):
    assert set(analyzed[1]) == {"clean", "fake", "twin", "wire", "crlf"}


def test_headers(analyzed):
    h = analyzed[1]["clean"].headers
    assert (h["from"].email, h["from"].name) == ("ann@example.com", "Ann Example")
    assert h.subject == "Grüße from the coast"
    assert h.message_id == "<1@example.com>" and len(h.received) == 2
    assert [d.source for d in h.domains] == ["From", "Return-Path"]
    assert analyzed[1]["crlf"].headers.subject == h.subject


def test_authentication(analyzed):
    clean, fake = analyzed[1]["clean"], analyzed[1]["fake"]
    assert (clean.spf.status, clean.dkim.status, clean.dmarc.status) == ("pass", "pass", "pass")
    assert clean.alignment.dmarc_aligned and clean.overall.level == "pass" and clean.trust.authserv_id == "mx.receiver.test"
    assert clean.sender_ip.public_ip == "203.0.113.9" and clean.sender_ip.private_ip == "192.168.1.23"
    assert [w for h in clean.route for w in h.warnings] == ["private origin"]
    assert (fake.spf.status, fake.dkim.status, fake.dmarc.status) == ("fail", "none", "fail")
    assert fake.alignment.dmarc_aligned is False and fake.alignment.reply_to_mismatch and fake.overall.level == "fail"


def test_body_and_files(analyzed):
    fake = analyzed[1]["fake"]
    assert "café" in fake.body_text and fake.password_form
    assert [(f.value, f.sniffed, [r.type for r in f.risks]) for f in fake.file_risks] == [("invoice.pdf.exe", "PE program", ["double-extension", "executable-content", "risky-extension"])]


def test_indicators(analyzed):
    fake = analyzed[1]["fake"]
    shown, url = fake.iocs.urls
    assert shown.value == "https://www.paypal.com/" and not shown.risks
    assert url.value == "http://paypa1-verify.top/login" and url.mismatch
    assert [r.type for r in url.risks] == ["risky-tld", "brand-lookalike", "mismatch"]
    assert {f.id for f in fake.findings} == {"display-name-brand", "lookalike-confusable", "replyto-freemail"}
    assert {f.id for f in analyzed[1]["twin"].findings} == {"display-name-brand", "lookalike-confusable", "replyto-freemail", "thread-fake-reply"}
    assert not analyzed[1]["clean"].findings and not analyzed[1]["clean"].iocs.urls[0].risks


def test_verdicts(analyzed):
    by = analyzed[1]
    assert by["clean"].tier == "Low Risk" and by["clean"].auth_points == 0
    assert by["fake"].tier == "High Risk" and "Malware delivery" in by["fake"].attack_types and "Sender spoofing" in by["fake"].attack_types
    assert (by["wire"].tier, by["wire"].score, by["wire"].attack_types) == ("Suspicious", 30, ["BEC / payment fraud"])


def test_campaign(analyzed):
    long = triage.message_indicators(analyzed[0])
    found = {}
    for r in correlate.members(long, correlate.shared(long)).orderBy("msg").collect():
        found.setdefault((r.type, r.value), []).append(r.msg)
    pair = ["fake", "twin"]
    for key in (("ip", "198.51.100.50"), ("replyTo", "help@gmail.com"), ("domain", "paypa1.com"), ("urlDomain", "paypa1-verify.top"), ("subject", "invoice # overdue"), ("mailer", "masssend 2"), ("filename", "invoice.pdf.exe")):
        assert found[key] == pair, key
    assert not any("clean" in m and "fake" in m for m in found.values())


def test_partitions_do_not_matter(spark, analyzed):
    rows = [("clean", CLEAN), ("fake", FAKE)]
    one = triage.analyze(spark.createDataFrame(rows, "msg_id string, raw string").coalesce(1)).select("msg_id", "score", "tier").collect()
    assert {(r.msg_id, r.score) for r in one} == {(k, analyzed[1][k].score) for k in ("clean", "fake")}


def test_lower_results_are_claims(spark):
    forged = FAKE.replace("From: PayPal", "Authentication-Results: evil.ru; spf=pass; dmarc=pass\nFrom: PayPal", 1)
    row = auth.authenticate(M.parse_headers(spark.createDataFrame([("x", forged)], "msg_id string, raw string"))).first()
    assert row.spf.status == "fail" and len([w for w in row.trust.warnings if "lower" in w]) == 2


def test_ip(spark):
    values = ["1.2.3.4", "010.1.1.1", "256.1.1.1", "1.2.3", "10.0.0.1", "100.64.0.1", "224.0.0.1", "172.32.0.1", "1.2.3.4\n", None]
    assert column(spark, values, net.valid_ipv4) == [True, False, False, False, True, True, True, True, False, False]
    assert column(spark, values, net.private_ipv4) == [False, False, False, False, True, True, True, False, False, False]
    six = ["::1", "::", "2001:db8::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "::ffff:192.0.2.1", "1::2::3", "12345::", "fe80::1", ":1:2", "1:2:3:4:5:6:7:8:9", ""]
    assert column(spark, six, net.valid_ipv6) == [True, True, True, True, False, True, False, False, True, False, False, False]
    assert column(spark, ["a 1.2.3.4, 15.21.360.10 1.2.3.4.5 8.8.8.8 1.2.3.4"], net.find_ipv4) == [["1.2.3.4", "8.8.8.8"]]


def test_domains(spark):
    assert column(spark, ["a.b.co.uk", "b.co.uk", "x.example.com.", "com", "", None, "A.B.C.D"], net.org_domain) == ["b.co.uk", "b.co.uk", "example.com", "com", None, None, "c.d"]
    assert column(spark, ["paypa1.com", "paypal.com", "paypol.com", "login-paypal.tld", "micr0s0ft.com", "example.com", "secure.apple.evil.tld", None], lambda c: net.lookalike(c)["kind"]) == ["confusable", None, "typosquat", "contains", "confusable", None, "contains", None]
    assert column(spark, ["acme.co", "acne.com", "acme.com"], lambda c: net.lookalike(c, ("acme.com",))["kind"]) == ["tld-swap", None, None]
    assert column(spark, ["https://u@h.example.COM:8443/x", "http://[::1]/", "nothing", "ftp://a.b."], net.url_host) == ["h.example.com", "[::1]", None, "a.b"]
    assert column(spark, ["bit.ly", "x.bit.ly", "notbit.ly"], lambda c: net.under_domain(c, ["bit.ly"])) == [True, True, False]


def test_text(spark):
    assert column(spark, ["RE: Invoice 4021  due", "Fwd: x", None], text.subject_key) == ["invoice # due", "x", ""]
    assert column(spark, ["https://a.b/c.d?e", "a.b"], text.defang_url) == ["hxxps[://]a[.]b/c.d?e", "a[.]b"]
    assert column(spark, ["x@y@a.b", "none"], text.defang_email) == ["x@y[@]a[.]b", "none"]
    assert column(spark, ["<p>a&amp;b</p><script>x</script> &lt;c&gt;"], text.strip_html) == ["a&b <c>"]
    assert column(spark, ["pаypal login", "paypal", "αβγ abc"], lambda c: F.size(text.mixed_script_words(c))) == [1, 0, 0]
    assert column(spark, ["a‮b", "ab"], text.bidi_control) == [True, False]


def test_score_rounding(spark):
    assert column(spark, [(50.0, 50.0, 50.0), (128.0, 25.0, 90.0), (0.0, 0.0, 10.0)], lambda c: score.total(c["a"], c["b"], c["c"]), "struct<a:double,b:double,c:double>") == [50, 80, 2]


def test_ranking(spark):
    rows = [(i, (i * 37) % 100) for i in range(200)]
    scored = spark.createDataFrame(rows, "msg int, score int").withColumn("tier", score.tier(F.col("score")))
    places = {r.msg: r.place for r in score.ranked(scored, "msg").collect()}
    order = sorted(rows, key=lambda r: (0 if r[1] >= 60 else 1 if r[1] >= 30 else 2, -r[1], r[0]))
    assert [places[m] for m, _ in order] == list(range(1, 201))


def test_matcher():
    m = language.Matcher([("bec", "strong", "wire transfer"), ("bec", "broad", "transfer"), ("bec", "strong", "new bank detail"), ("lure", "strong", "gift")])
    text_ = "Two wire transfers; the Transfer's gift and new bank details"
    assert [(c, t, text_[s : s + n]) for c, t, s, n in m.find(text_)] == [("bec", "strong", "wire transfers"), ("bec", "broad", "Transfer's"), ("lure", "strong", "gift"), ("bec", "strong", "new bank details")]


def test_mime_never_raises():
    import random

    rng = random.Random(0x5EED)
    for seed in (CLEAN, FAKE, WIRE):
        for _ in range(100):
            b = list(seed)
            for _ in range(rng.randint(1, 30)):
                b[rng.randrange(len(b))] = chr(rng.choice([0, 10, 13, 34, 45, 58, 61, 255, 0x20AC, 0x1F600]))
            out = {"text": [], "html": [], "files": []}
            mime.walk(*mime.split_head("".join(b)), out)
    deep = "".join(f"Content-Type: multipart/mixed; boundary=b{i}\n\n--b{i}\n" for i in range(200))
    mime.walk(*mime.split_head(deep), {"text": [], "html": [], "files": []})
