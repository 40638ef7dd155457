"""Results and bounds that findings of round 3 asked for."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailtriage.functions import batches, net
from mailtriage.functions import text as T
from mailtriage.operators import language
from mailtriage.plans import corpus_queries, triage


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    rows = [(i, user, at) for i, (user, at) in enumerate([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 09:00:00"), (1, "2024-01-01 09:30:00"), (2, "2024-01-01 08:00:00")])]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, ts string")
    frame.selectExpr("event_id", "user_id", "to_timestamp(ts) as ts").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_hops_tell_the_place_of_the_first(spark, events):
    got = {r.user_id: (r.n_hops, r.n_backwards, r.n_first) for r in corpus_queries.hop_time_regression(spark, events).collect()}
    assert got == {1: (3, 1, 3), 2: (1, 0, 1)}


def test_batches_are_read_in_small_slices():
    rows = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(["x" * 300] * 10_000)], ["id", "text"])
    parts = list(batches.slices(rows))
    assert max(p.num_rows for p in parts) <= batches.SLICE_ROWS
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([rows]))
    long = pa.array(["x" * batches.SLICE_BYTES] * 5)
    assert [len(p) for p in batches.slices(long)] == [1] * 5
    seen = []
    assert batches.by_slices(lambda a: seen.append(len(a)) or a)(rows.column(0)).equals(rows.column(0)) and max(seen) <= batches.SLICE_ROWS
    assert len(batches.by_slices(lambda a: a)(pa.array([], pa.string()))) == 0


def test_python_passes_hold_a_slice_at_a_time(spark):
    """Phrases of a text come out the same whatever the slices are."""
    texts = spark.range(700).select(F.col("id").alias("msg_id"), F.concat(F.lit("wire transfer of invoice "), F.col("id").cast("string")).alias("text")).coalesce(1)
    found = language.matches(texts).groupBy("msg_id").count().collect()
    assert len(found) == 700 and {r["count"] for r in found} == {2}
    hits = texts.select(F.size(language.hits(F.col("text"))).alias("n")).groupBy("n").count().collect()
    assert [tuple(r) for r in hits] == [(2, 700)]


def test_unused_findings_are_not_computed(spark):
    raw = spark.createDataFrame([(1, "From: <a@b.test>\nSubject: x\n\nsee http://files.example.top/get.exe\n")], "msg_id long, raw string")
    plan = triage.analyze(raw).select("msg_id", "iocs.urls")._jdf.queryExecution().optimizedPlan().toString()
    assert "envelope-from" not in plan and "arc-seal" not in plan


_MARKED = "a\u0001b http://x.example.com/a.b?c=d@e.example.org, y@mail.example.com. 203.0.113.9 \u0001 header.from f.pdf \u0001"


def test_defanged_in_one_pass(spark):
    """A text with the mark that other texts get is read right as well, and counts agree."""
    texts = [_MARKED, _MARKED.replace("\u0001", "|"), "", None, "a-b@c.example.org-d@e.example.com", "nothing", "x.example.com"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.defanged(F.col("t")).alias("d"), T.defang_targets(F.col("t")).alias("n")).collect()
    got = {r.t: (r.d.text, r.d.n) for r in rows}
    assert got[_MARKED][0].replace("\u0001", "|") == got[_MARKED.replace("\u0001", "|")][0] and got[_MARKED][1] == got[_MARKED.replace("\u0001", "|")][1] == 5
    assert "hxxp[://]x[.]example[.]com" in got[_MARKED][0] and "y[@]mail[.]example[.]com" in got[_MARKED][0] and "header.from f.pdf" in got[_MARKED][0]
    assert all(r.n == r.d.n for r in rows if r.t is not None)
    assert got["a-b@c.example.org-d@e.example.com"][0] == "a-b[@]c[.]example[.]org-d[@]e[.]example[.]com" and got[""] == ("", 0) and got[None][0] is None


def test_addresses_of_runs(spark):
    text = "1.2.3.4. 5.6.7.8, 9.9.9.9.9 .1.1.1.1 256.1.1.1 x::1 ::1 fe80::1: IPv6:2001:db8::2. a:b 10:20"
    row = spark.createDataFrame([(text,)], "t string").select(net.find_ipv4(F.col("t")).alias("four"), net.find_ipv6(F.col("t")).alias("six")).first()
    plain4 = [m for m in dict.fromkeys(re.findall("[0-9.]+", text)) if re.fullmatch(net.IPV4.strip("^$"), m)]
    assert row.four == plain4 and row.six == ["::1", "fe80::1", "2001:db8::2"]
