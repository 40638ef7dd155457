"""Comparison of messages, whole exports and attached messages."""

import json

import pytest

from mailtriage.operators import compare, correlate, export
from mailtriage.plans import triage
from mailtriage.sources import mime

from .samples import CLEAN, FAKE, TWIN

AT = "2024-01-01T00:00:00.000Z"


def attaching(inner: str, name: str = "") -> str:
    named = f'; name="{name}"' if name else ""
    return f'From: <a@b.test>\nSubject: outer\nContent-Type: multipart/mixed; boundary="o{len(inner)}"\n\n--o{len(inner)}\nContent-Type: text/plain\n\nsee below\n--o{len(inner)}\nContent-Type: message/rfc822{named}\n\n{inner}\n--o{len(inner)}--\n'


@pytest.fixture(scope="module")
def analyzed(spark):
    rows = spark.createDataFrame([("clean", CLEAN), ("fake", FAKE), ("twin", TWIN)], "msg_id string, raw string")
    return triage.analyze(rows).cache()


def test_cells(analyzed):
    found = compare.cells(analyzed).collect()
    by = {(r.property, r.msg): r for r in found}
    assert len(found) == 3 * 29 and len(by) == len(found)
    assert (by["spf", "clean"].value, by["spf", "clean"].tone) == ("PASS", "good") and (by["spf", "fake"].value, by["spf", "fake"].tone) == ("FAIL", "bad")
    assert (by["dkim", "fake"].value, by["dkim", "fake"].tone) == ("NONE", "muted")
    assert (by["alignment", "clean"].value, by["alignment", "fake"].tone) == ("Aligned", "bad")
    assert by["verdict", "clean"].tone == "good" and by["verdict", "fake"].tone == "bad"
    assert by["from_domain", "fake"].value == "paypa1.com" and by["mailer", "clean"].value == compare.DASH and by["mailer", "clean"].keys == []
    assert by["deceptive_links", "fake"].tone == "bad" and by["attachments", "fake"].tone == "bad" and by["hashes", "clean"].value == compare.DASH


def test_shared_and_wide(analyzed):
    cells = compare.cells(analyzed)
    found = correlate.shared(triage.message_indicators(analyzed))
    marked = {(r.property, r.msg): r.shared for r in compare.mark_shared(cells, found).collect()}
    assert len(marked) == 3 * 29
    assert marked["hashes", "fake"] and marked["hashes", "twin"] and marked["mailer", "twin"] and marked["subject", "twin"]
    assert not marked["mailer", "clean"] and not marked["from", "fake"] and not marked["verdict", "fake"]
    assert {r.type for r in compare.strong_links(found).collect()} >= {"hash", "ip", "url", "replyTo"}

    table = compare.wide(cells, ["fake", "twin"])
    same = {r.property: r.identical for r in table.collect()}
    assert len(same) == 29 and same["spf"] and same["hashes"] and not same["from"]
    differing = {r.property for r in compare.wide(cells, ["fake", "twin"], differing_only=True).collect()}
    assert differing == {p for p, identical in same.items() if not identical}
    assert not any(r.identical for r in compare.wide(cells, ["fake"]).collect())

    lines = [r.line for r in compare.csv_lines(table, ["fake", "twin"]).orderBy("ord").collect()]
    assert lines[0] == "property,fake,twin" and lines[4] == "spf,FAIL,FAIL" and len(lines) == 30
    with pytest.raises(ValueError, match="heading"):
        compare.csv_lines(table, ["a,b"])
    objects = {r.msg: json.loads(r.object) for r in compare.json_documents(analyzed).collect()}
    assert objects["fake"]["verdict"] == "High Risk" and objects["clean"]["properties"]["from"] == "ann@example.com" and len(objects["twin"]["properties"]) == 29


def test_no_messages(spark, analyzed):
    none = analyzed.where("msg_id = 'x'")
    assert compare.cells(none).count() == 0
    assert compare.mark_shared(compare.cells(none), correlate.shared(triage.message_indicators(none))).count() == 0


def test_bundles(analyzed):
    report = export.report_rows(analyzed)
    bundles = {r.msg_id: json.loads(r.bundle) for r in export.stix_bundles(analyzed, export.stix_objects(report, AT), AT).collect()}
    assert set(bundles) == {"clean", "fake", "twin"}
    for bundle in bundles.values():
        ids = [o["id"] for o in bundle["objects"]]
        (told,) = [o for o in bundle["objects"] if o["type"] == "report"]
        (mail,) = [o for o in bundle["objects"] if o["type"] == "email-message"]
        assert len(set(ids)) == len(ids) and set(told["object_refs"]) == set(ids) - {told["id"]} and mail["from_ref"] in ids
    events = {r.msg_id: json.loads(r.event)["Event"] for r in export.misp_events(analyzed, export.misp_attributes(report), "2024-01-01").collect()}
    assert events["fake"]["threat_level_id"] == "1" and events["clean"]["threat_level_id"] == "3"
    assert any(a["type"] == "sha256" and a["to_ids"] for a in events["fake"]["Attribute"])


def test_url_groups(spark):
    wrapped = "https://eur01.safelinks.protection.outlook.com/?url=http%3A%2F%2Fevil.test%2Flogin&data=1"
    rows = spark.createDataFrame([("w", CLEAN.replace("https://www.example.com/page", wrapped)), ("c", CLEAN)], "msg_id string, raw string")
    assert [(r.msg_id, r.url, r.destinations) for r in export.url_groups(triage.analyze(rows)).collect()] == [("w", wrapped, ["http://evil.test/login"])]


def test_attached_messages(spark):
    deep = CLEAN
    for _ in range(5):
        deep = attaching(deep)
    rows = spark.createDataFrame([("plain", CLEAN), ("one", attaching(CLEAN, "note.eml")), ("deep", deep), ("null", None), ("empty", "")], "msg_id string, raw string")
    found = {r.msg_id: r for r in mime.with_attached(rows.repartition(2)).collect()}
    assert set(found) == {"plain", "one", "one/0", "deep", "null", "empty", *("deep" + "/0" * i for i in range(1, 6))}
    assert found["one/0"].parent_msg_id == "one" and found["one"].parent_msg_id is None and found["null"].raw is None
    assert found["one/0"].raw.strip() == CLEAN.strip() and found["deep/0/0/0/0/0"].raw.strip() == CLEAN.strip()
    inner = triage.analyze(mime.with_attached(rows.where("msg_id = 'one'"))).select("msg_id", "parent_msg_id", "headers.from.email").collect()
    assert sorted((r.msg_id, r.email) for r in inner) == [("one", "a@b.test"), ("one/0", "ann@example.com")]
