"""Exports and URL decoders."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from mailtriage.functions import urldecode as u
from mailtriage.operators import export


@pytest.fixture(scope="module")
def report(spark):
    schema = "msg_id string, ord int, type string, value string, indicator string, risk_flags string, details string, high boolean"
    rows = [
        ("m", 0, "url", "http://evil.test/a'b?x=1,2", "hxxp[://]evil[.]test/a'b?x=1,2", "punycode; ip-url", "", True),
        ("m", 1, "ip", "10.0.0.1", "10[.]0[.]0[.]1", "", "private/reserved address", False),
        ("m", 2, "ip", "8.8.8.8", "8[.]8[.]8[.]8", "", "", False),
        ("m", 3, "filename", "=cmd|x", "=cmd|x", "", "", False),
        ("m", 4, "ip", "8.8.8.8", "8[.]8[.]8[.]8", "", "", False),
    ]
    return spark.createDataFrame(rows, schema)


def test_uuid5(spark):
    name = '{"value":"8.8.8.8"}'
    got = spark.range(1).select(export.uuid5(F.lit(name))).first()[0]
    assert got == str(uuid.uuid5(uuid.UUID(export.STIX_NAMESPACE), name))


def test_csv(report, spark):
    text = export.csv_documents(export.csv_lines(report)).first().csv
    lines = text.split("\r\n")
    assert lines[0] == "﻿type,indicator,source,risk_flags,details,virustotal,abuseipdb,registration" and lines[-1] == ""
    assert lines[1] == "url,\"hxxp[://]evil[.]test/a'b?x=1,2\",Message,punycode; ip-url,,,,"
    assert lines[4].startswith("filename,'=cmd|x,")
    known = spark.createDataFrame([("vt", "8.8.8.8", "clean")], "kind string, value string, summary string")
    assert "ip,8[.]8[.]8[.]8,Message,,,clean,," in export.csv_documents(export.csv_lines(report, known)).first().csv


def test_stix(report):
    rows = export.stix_objects(report, "2024-01-01T00:00:00.000Z").collect()
    objects = [json.loads(r.object) for r in rows]
    assert sorted(o["type"] for o in objects) == ["indicator", "indicator", "ipv4-addr", "url"]
    assert len({o["id"] for o in objects}) == 4
    (url,) = [o for o in objects if o["type"] == "indicator" and "url:value" in o["pattern"]]
    assert url["pattern"] == "[url:value = 'http://evil.test/a\\'b?x=1,2']" and url["indicator_types"] == ["malicious-activity"]
    assert "10.0.0.1" not in json.dumps(objects)


def test_misp(report):
    rows = {(r.type, r.value): r.to_ids for r in export.misp_attributes(report).collect()}
    assert rows["url", "http://evil.test/a'b?x=1,2"] and not rows["ip-src", "8.8.8.8"]


def test_decoders():
    wrapped = "https://nam02.safelinks.protection.outlook.com/?url=https%3A%2F%2Fwww.google.com%2Furl%3Fq%3Dhttps%3A%2F%2Fevil.test%2Fx&data=1"
    assert u.unwrap(wrapped) == ("https://evil.test/x", "Unwrapped: Microsoft Defender Safe Links → Google redirect")
    assert u.unwrap("https://urldefense.proofpoint.com/v2/url?u=http-3A__evil.test_x&d=1")[0] == "http://evil.test/x"
    assert u.unwrap("https://urldefense.com/v3/__https://example.com/a*b**Ac__;IyEh!!xyz")[0] == "https://example.com/a#b!!c"
    assert "not in the link" in u.unwrap("https://protect-us.mimecast.com/s/abc")[1]
    assert u.unwrap("https://example.com/?page=2") is None
    assert u.unwrap("https://x.test/r?next=https://evil.test/")[0] == "https://evil.test/"
    assert u.percent("a%252520b") == ("a b", "3 layers of encoding") and u.percent("a%zz") is None and u.percent("%e9")[0] == "é"
    assert u.base64_tokens("https://x.test/#dmljdGltQGNvbXBhbnkuY29t")[1]
    assert u.punycode("http://xn--pypal-4ve.com/x")[0] == "http://pаypal.com/x"
    assert u.escapes(r"\u{1F600}\x41")[0] == "😀A"
    assert u.everything("https://example.com/") is None


def test_decode_table(spark):
    urls = spark.createDataFrame([("https://x.test/r?next=https://evil.test/",), ("https://x.test/r?next=https://evil.test/",), (None,), ("plain",)], "url string")
    assert [(r.url, r.destination) for r in u.destinations(urls).collect()] == [("https://x.test/r?next=https://evil.test/", "https://evil.test/")]


def test_decoders_never_raise():
    import random

    rng = random.Random(7)
    seeds = ["https://urldefense.com/v3/__https://e.com/a*b**Ac__;IyEh!!x", "http://xn--pypal-4ve.com/%2525", "https://l.facebook.com/l.php?u=http%3A%2F%2Fa.b", "&#x41;\\u{41}%41"]
    for seed in seeds:
        for _ in range(300):
            b = list(seed)
            for _ in range(rng.randint(1, 6)):
                b[rng.randrange(len(b))] = chr(rng.choice([37, 42, 91, 93, 58, 47, 0, 233, 0x1F600, 61, 38]))
            for f in u.DECODERS.values():
                f("".join(b))
