"""Encoded input, charsets, compatibility forms, highlighting."""

import base64
import html
import random

from pyspark.sql import functions as F

from mailtriage.functions import charsets, encoded, net
from mailtriage.operators import highlight
from mailtriage.sources import messages as M


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").coalesce(1)
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_encoded_input(spark):
    data = bytes(range(256))
    h, b = data.hex(), base64.b64encode(data).decode()
    dump = "\n".join(f"{i:08x}  {data[i : i + 16].hex(' ')}  |{'.' * 16}|" for i in range(0, 256, 16))
    good = {
        h: "hex", h.upper(): "hex", data.hex(" "): "hex", data.hex(":"): "hex", "0x" + ",0x".join(f"{x:02x}" for x in data): "hex", "".join(f"\\x{x:02x}" for x in data): "hex", dump: "hex",
        b: "base64", b.rstrip("="): "base64", base64.urlsafe_b64encode(data).decode(): "base64", base64.encodebytes(data).decode(): "base64", f"  data:image/png;base64,{b}\n": "data URI",
    }
    found = column(spark, list(good), encoded.decoded)
    assert [(r.kind, bytes(r.content), r.reason) for r in found] == [(kind, data, None) for kind in good.values()]
    bad = {"": "empty", " \n": "empty", None: "empty", "abc": "an odd number of hex digits: 3", "no, this!": "neither hex nor Base64", "QUJDR": "neither hex nor Base64", "data:x;base64,@@": "neither hex nor Base64"}
    assert [(r.kind, r.content, r.reason) for r in column(spark, list(bad), encoded.decoded)] == [(None, None, why) for why in bad.values()]


def test_charsets(spark):
    for name in ("windows-1251", "koi8-r", "iso-8859-2", "windows-1253", "macintosh", "windows-1252"):
        raw = bytes(range(32, 256))
        want = raw[:96].decode("ascii", "replace").replace("�", "") + charsets.upper_half(name)
        assert column(spark, [bytearray(raw)], lambda c, n=None, name=name: charsets.single_byte(c, F.lit(name.upper())), "binary") == [want]
    assert column(spark, [bytearray(b"x")], lambda c: charsets.single_byte(c, F.lit("utf-7")), "binary") == [None]
    subject = "=?windows-1251?B?" + base64.b64encode("Счёт".encode("cp1251")).decode() + "?= =?koi8-r?Q?=F0=D2=C9?= =?iso-8859-1?Q?caf=E9_=80?= =?x-odd?Q?=41?="
    assert column(spark, [subject], M.decoded_words) == ["Счёт При café € =?x-odd?Q?=41?="]


def test_compatibility(spark):
    assert column(spark, ["ＰａｙＰａｌ", "ｎｅｔﬂix", "𝐩𝐚𝐲𝐩𝐚𝐥", "ⓟaypal", "plain ABC", "é東", "㎏", None], charsets.compatible) == ["paypal", "netflix", "paypal", "paypal", "plain ABC", "é東", "kg", None]
    assert column(spark, ["ＰａｙＰａｌ.com", "ｎｅｔﬂix.com", "paypal.com"], lambda h: net.lookalike(h)["kind"]) == ["confusable", "confusable", None]


def plain_highlight(text, found):
    marks = sorted(m for m in found if m[1] > 0)
    merged = []
    for start, length, category, tier in marks:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], start + length)
            merged[-1][2] |= tier == "strong"
            merged[-1][3] += [] if category in merged[-1][3] else [category]
        else:
            merged.append([start, start + length, tier == "strong", [category]])
    out, at = "", 0
    for start, stop, strong, categories in merged:
        out += html.escape(text[at:start]).replace("&#x27;", "&#39;") + f'<mark class="highlight-{categories[0]}{"" if strong else " broad"}" title="{", ".join(categories)}">' + html.escape(text[start:stop]).replace("&#x27;", "&#39;") + "</mark>"
        at = stop
    return out + html.escape(text[at:]).replace("&#x27;", "&#39;")


def test_highlighting(spark):
    rng = random.Random(12)
    texts, matches, want = [], [], {}
    for i in range(120):
        text = "".join(rng.choices("ab <>&\"' é", k=rng.randint(0, 40)))
        own = {}
        for _ in range(rng.randint(0, 6) if text else 0):
            start = rng.randrange(len(text))
            length, category = rng.randint(0, min(8, len(text) - start)), rng.choice("xyz")
            own[start, length, category] = rng.choice(["strong", "broad"])
        # Of equal starts the shorter comes first, then the tier, then the category.
        rows = [(s, n, c, t) for (s, n, c), t in own.items()]
        texts.append((i, text))
        matches += [(i, c, t, s, n) for s, n, c, t in rows]
        ordered = sorted(rows, key=lambda r: (r[0], r[0] + r[1], r[3] == "strong", r[2]))
        want[i] = plain_highlight_in_order(text, ordered)
    found = highlight.highlighted_texts(spark.createDataFrame(texts, "msg_id int, text string"), spark.createDataFrame(matches, "msg_id int, category string, tier string, idx int, length int"))
    assert {r.msg_id: r.highlighted for r in found.collect()} == want


def plain_highlight_in_order(text, rows):
    keyed = [(k, *r) for k, r in enumerate(rows)]
    merged = []
    for _, start, length, category, tier in keyed:
        if length <= 0:
            continue
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], start + length)
            merged[-1][2] |= tier == "strong"
            merged[-1][3] += [] if category in merged[-1][3] else [category]
        else:
            merged.append([start, start + length, tier == "strong", [category]])
    out, at = "", 0

    def safe(s):
        return html.escape(s).replace("&#x27;", "&#39;")

    for start, stop, strong, categories in merged:
        out += safe(text[at:start]) + f'<mark class="highlight-{categories[0]}{"" if strong else " broad"}" title="{", ".join(categories)}">' + safe(text[start:stop]) + "</mark>"
        at = stop
    return out + safe(text[at:])
