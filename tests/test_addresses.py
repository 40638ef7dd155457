"""Addresses as values, nesting in headers, sources of addresses, defanged text."""

import ipaddress
import random

from pyspark.sql import functions as F

from mailtriage.functions import net, text
from mailtriage.operators import auth, correlate


def column(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").coalesce(1)
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def number(row):
    return None if row is None else ((row.hi % 2**64) << 64) | (row.lo % 2**64)


def test_values(spark):
    rng = random.Random(6)
    six = [ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([2**128 - 1, 2**64 - 1, (2**32 - 1) << 96])) for _ in range(60)]
    spellings = [s for a in six for s in (str(a), a.exploded, a.exploded.upper())] + ["::", "::1", "1::", "::ffff:192.0.2.1", "64:ff9b::192.0.2.33", "192.0.2.1", "255.255.255.255", "0.0.0.0"]
    found = [number(x) for x in column(spark, spellings, net.ip_value)]
    want = [int(ipaddress.ip_address(s)) if ":" in s else int(ipaddress.IPv6Address("::ffff:" + s)) for s in spellings]
    assert found == want
    assert column(spark, ["1.2.3", "1:2", "::1::", "g::1", "", None, "010.1.1.1"], net.ip_value) == [None] * 7
    full = column(spark, ["2001:DB8::1", "::ffff:192.0.2.1", "192.0.2.1"], lambda v: net.ip_full(net.ip_value(v)))
    assert full == ["2001:0db8:0000:0000:0000:0000:0000:0001", "192.0.2.1", "192.0.2.1"]


def test_masks(spark):
    for length in (0, 1, 32, 63, 64, 65, 96, 127, 128):
        got = number(column(spark, ["fedc:ba98:7654:3210:fedc:ba98:7654:3210"], lambda v: net.ip_masked(net.ip_value(v), F.lit(length)))[0])
        assert got == int(ipaddress.ip_network(f"fedc:ba98:7654:3210:fedc:ba98:7654:3210/{length}", strict=False).network_address)


def test_found_in_text(spark):
    said = "from [IPv6:2001:db8::1]:25 at 10:00:05, see 2001:DB8:0:0::2. or ::ffff:192.0.2.7, ratio 1:2:3, mac aa:bb:cc:dd:ee:ff, 198.51.100.4 fe80::1: end"
    assert column(spark, [said, None, ""], net.find_ips) == [["192.0.2.7", "198.51.100.4", "2001:db8::1", "2001:DB8:0:0::2", "::ffff:192.0.2.7", "fe80::1"], None, []]


def plain_scan(value):
    """The header's parts, letter by letter."""
    parts, depth, quoted = [""], 0, False
    for i, c in enumerate(value):
        if not quoted and depth == 0 and c == ";":
            parts.append("")
            continue
        parts[-1] += c
        if quoted:
            quoted = not (c == '"' and value[i - 1] != "\\")
        elif c == '"':
            quoted = True
        else:
            depth = depth + 1 if c == "(" else max(0, depth - 1) if c == ")" else depth
    out = []
    for part in parts:
        shown, inner = "", 0
        for c in part:
            if c in "()":
                inner = inner + 1 if c == "(" else max(0, inner - 1)
            elif not inner:
                shown += c
        out.append(shown)
    return out


def test_nesting(spark):
    rng = random.Random(9)
    values = ["".join(rng.choices(["(", ")", '"', ";", "\\", "ab", " "], k=rng.randint(0, 40))) for _ in range(300)]
    values += ["(" * 50 + "x;" + ")" * 50 + "spf=pass; a", 'mx; spf=pass reason="a;b;c;d"; dkim=pass', "(a;" * 3000 + "b" + ")" * 3000 + "; c", "plain; values", ""]
    assert column(spark, values, lambda v: auth.scan(v, True)) == [plain_scan(v) for v in values]
    assert column(spark, ["a (b (c) d) e", None], auth.without_comments) == ["a  e", None]
    found = column(spark, [values[301]], auth.clauses)[0]
    assert [(c.method, c.result) for c in found] == [("spf", "pass"), ("dkim", "pass")]


def test_precedence(spark):
    rows = [("m", "ip1", "Body", 2, 0), ("m", "ip1", "Received", 1, 5), ("m", "ip1", "Received", 1, 3), ("m", "ip2", "Body", 2, 4), ("n", "ip1", "X-Originating-IP", 0, 9)]
    found = correlate.with_precedence(spark.createDataFrame(rows, "msg string, value string, source string, rank int, place int"), ["msg", "value"])
    assert {(r.msg, r.value): (r.source, r.sources, r.place) for r in found.collect()} == {
        ("m", "ip1"): ("Received", ["Body", "Received"], 3), ("m", "ip2"): ("Body", ["Body"], 4), ("n", "ip1"): ("X-Originating-IP", ["X-Originating-IP"], 9),
    }


def test_defanged_text(spark):
    cases = {
        "see https://user@evil.test:80/a.b?u=http%3A%2F%2Fbad.example.com and mail Ann@mail.example.com": "see hxxps[://]user[@]evil[.]test:80/a.b?u=http%3A%2F%2Fbad[.]example[.]com and mail Ann[@]mail[.]example[.]com",
        "192.0.2.1 header.from smtp.mailfrom Invoice.pdf.exe evil.zip www.x.co.uk.": "192[.]0[.]2[.]1 header.from smtp.mailfrom Invoice.pdf.exe evil[.]zip www[.]x[.]co[.]uk.",
        "FTP://files.test/x": "fxp[://]files[.]test/x", "nothing here": "nothing here", "": "", "v1.2 of 3.4": "v1.2 of 3.4",
    }
    assert dict(zip(cases, column(spark, list(cases), text.defang_text), strict=True)) == cases
    assert column(spark, [None], text.defang_text) == [None]
