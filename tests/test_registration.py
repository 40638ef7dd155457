"""Bootstrap lists, registration answers, referral chains."""

import json

from pyspark.sql import functions as F

from mailtriage.operators import referrals, registration


def listed(spark):
    bodies = [
        json.dumps({"services": [[["com", "NET"], ["https://b.test/", "https://a.test"]], [["uk"], ["https://uk.test"]], [["co.uk"], ["https://co.test"]], [["com"], ["https://a.test"]], [["bad label"], ["https://x.test"]]]}),
        json.dumps({"services": [[["0.0.0.0/0"], ["https://all.test"]], [["10.0.0.0/8", "10.1.0.0/16", "10.1.2.3/32"], ["https://ten.test"]], [["10.1.0.0/33", "10.0.0.0/x"], ["https://no.test"]], [["::/0"], ["https://six.test"]]]}),
        "no json", "{}", None,
    ]
    return registration.services(spark.createDataFrame([(b,) for b in bodies], "body string"))


def test_servers(spark):
    targets = [("domain", " Www.Example.COM"), ("domain", "a.b.co.uk."), ("domain", "x.uk"), ("domain", "x.org"), ("domain", "com"), ("ip", "10.1.2.3"), ("ip", "10.1.9.9"), ("ip", "11.0.0.1"), ("ip", "::FFFF:10.2.0.1"), ("ip", "2001:db8::1"), ("ip", "junk"), ("domain", None), (None, None), ("domain", " Www.Example.COM")]
    found = registration.server_of(spark.createDataFrame(targets, "kind string, value string"), listed(spark)).collect()
    got = {(r.kind, r.value): (r.server, r.matched) for r in found}
    assert len(found) == len(got) == 13
    assert got["domain", "www.example.com"] == ("https://a.test", "com") and got["domain", "a.b.co.uk."] == ("https://co.test", "co.uk") and got["domain", "x.uk"][0] == "https://uk.test"
    assert got["domain", "x.org"] == (None, None) == got["ip", "junk"] == got["domain", None]
    assert got["ip", "10.1.2.3"] == ("https://ten.test", "128") and got["ip", "10.1.9.9"] == ("https://ten.test", "112") and got["ip", "11.0.0.1"] == ("https://all.test", "96")
    assert got["ip", "::ffff:10.2.0.1"] == ("https://ten.test", "104") and got["ip", "2001:db8::1"] == ("https://six.test", "0")


def test_questions(spark):
    targets = spark.createDataFrame([("domain", "a.com"), ("domain", "B.com"), ("domain", "c.com"), ("domain", "d.org"), ("ip", "2001:db8::1")], "kind string, value string")
    answers = spark.createDataFrame([("domain", "A.com", True), ("domain", "b.com", False)], "kind string, value string, ok boolean")
    assert {r.url for r in registration.questions(targets, listed(spark), answers).collect()} == {"https://a.test/domain/b.com", "https://a.test/domain/c.com", "https://six.test/ip/2001%3Adb8%3A%3A1"}


def test_answers(spark):
    network = {"handle": "NET-1", "startAddress": "192.0.2.0", "endAddress": "192.0.2.255", "name": "TEST", "country": "NL", "type": "ASSIGNED", "entities": [{"vcardArray": ["vcard", [["fn", {}, "text", "First"], ["org", {}, "text", ["a", "b"]]]]}]}
    bodies = [("n", json.dumps(network)), ("e", "{}"), ("x", "junk"), ("v", json.dumps({"ldhName": "v.test", "entities": [{"roles": ["abuse"], "vcardArray": "odd"}, {}]})), ("q", None)]
    rows = spark.createDataFrame(bodies, "id string, body string").withColumn("r", registration.registration(F.col("body"))).collect()
    got = {r.id: r.r for r in rows}
    assert (got["n"].target, got["n"].range, got["n"].registrant, got["n"].country, got["n"].network) == ("NET-1", "192.0.2.0 – 192.0.2.255", "First", "NL", "TEST")
    assert got["e"].target is None and got["e"].statuses == [] and got["x"] is None and got["q"] is None
    assert got["v"].target == "v.test" and got["v"].abuse_email is None


def test_enriched(spark):
    targets = spark.createDataFrame([(1, "domain", "A.test"), (2, "domain", "a.test"), (3, "domain", "b.test"), (4, None, None)], "id int, kind string, value string")
    answers = spark.createDataFrame([("domain", "a.test", True, '{"ldhName":"z"}'), ("domain", "a.test", True, '{"ldhName":"a"}'), ("domain", "b.test", False, '{"ldhName":"b"}')], "kind string, value string, ok boolean, body string")
    found = {r.id: r.registration and r.registration.target for r in registration.enriched(targets, answers).collect()}
    assert found == {1: "a", 2: "a", 3: None, 4: None}


def chain(spark, targets, answers, **options):
    rows = referrals.follow(spark.createDataFrame([(t,) for t in targets], "value string"), spark.createDataFrame(answers, "server string, query string, text string"), **options).collect()
    assert len({r.value for r in rows}) == len(rows)
    return {r.value: (r.servers, r.ended) for r in rows}


def test_chains(spark):
    root = referrals.ROOT
    answers = [
        (root, "com", "refer: whois.one"), (root.upper(), "COM", "refer: whois.two"), ("whois.one", "a.com", "Registrar WHOIS Server: r.one\n"), ("r.one", "a.com", "whois: whois.one"),
        ("whois.one", "b.com", "text without referral"), ("whois.one", "c.com", None), (root, "192.0.2.1", "refer:   whois.net\n"), ("whois.net", "192.0.2.1", "NetRange: x"), ("s0", "d.com", "x"),
    ]
    got = chain(spark, ["A.com", "a.com ", "b.com", "c.com", "192.0.2.1", "x.org", None, ""], answers)
    assert got == {"a.com": ([root, "whois.one", "r.one"], "cycle"), "b.com": ([root, "whois.one"], "answer"), "c.com": ([root, "whois.one"][:1], "missing"), "192.0.2.1": ([root, "whois.net"], "answer"), "x.org": ([], "missing")}
    assert chain(spark, [], answers) == {}
    assert chain(spark, ["self.com"], [(root, "com", f"refer: {root}")]) == {"self.com": ([root], "cycle")}


def test_long_chains_are_cut(spark):
    answers = [(referrals.ROOT, "com", "refer: s1")] + [(f"s{i}", "a.com", f"refer: s{i + 1}") for i in range(1, 9)]
    assert chain(spark, ["a.com"], answers, most=4) == {"a.com": ([referrals.ROOT, "s1", "s2", "s3"], "cut")}


def test_summary(spark):
    said = "Domain Name: X.TEST\r\ncreated:  2020\nCreation Date: 2019\nStatus: one\nDomain Status: two\nnserver: NS1.x.test 192.0.2.1\nName Server: ns2.X.test\nRegistrar:\nRegistrar Abuse Contact Email: a@b.cd\n"
    row = spark.createDataFrame([(said,), ("\n  No Match for x",), (None,)], "t string").select(referrals.summary(F.col("t")).alias("s")).collect()
    s = row[0].s
    assert (s.target, s.registered, s.statuses, s.nameservers, s.registrar, s.abuse_email, s.not_found) == ("X.TEST", "2019", ["one", "two"], ["ns1.x.test", "ns2.x.test"], None, "a@b.cd", False)
    assert row[1].s.not_found and row[1].s.target is None and row[1].s.nameservers == []
