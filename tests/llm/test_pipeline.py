"""The pipeline against plain Python, and the queries' SQL against their rows."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from mailtriage.llm import language_id
from mailtriage.llm import queries as q

from .fixtures import lower, odd_rows, prose, write
from .test_duplicates import brute_links
from .test_native import brute_targets
from .test_text import brute_contamination

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The odd documents with more prose, copies, near copies and benchmark passages among them."""
    rng = random.Random(21)
    path = tmp_path_factory.mktemp("corpus")
    items = [(i, prose(rng, 30)) for i in range(4)]
    rows = odd_rows()
    for i in range(100, 160):
        text = prose(rng, 80)
        if i % 10 == 0:
            text = text + " " + items[i % 4][1]
        rows.append((i, text, ("en", "de")[i % 2], f"s{i % 4}"))
    rows += [(200 + i, rows[-i - 1][1].upper(), "en", "a") for i in range(5)]
    rows += [(300 + i, rows[-i - 9][1] + " end", "en", "b") for i in range(5)]
    write(spark, rows, f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_stages(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = language_id.train(docs)
    good = {r.doc_id for r in language_id.identify(docs, model).collect() if r.accepted}
    here = sorted(((d, t, s) for d, t, _, s in rows if model.predict([t])[0][2]), key=str)
    assert good >= set(range(100, 160))

    last: dict = {}
    for d, t, s in here:  # the largest id of equal texts stays
        key = lower(t)
        if key not in last or (d is not None and (last[key][0] is None or d >= last[key][0])):
            last[key] = (d, t, s)
    here = list(last.values())
    parent = brute_links([(d, t) for d, t, _ in here], 5, 80, 100)
    here = [x for x in here if x[0] is None or parent[x[0]] == x[0]]
    hit = {d for d, _ in brute_contamination([(d, t) for d, t, _ in here], items)}
    here = [x for x in here if x[0] not in hit]

    out = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = out.columns
        out = stage(spark, out, path)
        if name != "mixing":
            assert out.columns == before
            out.write.parquet(f"{path}/{name}")
            out = spark.read.parquet(f"{path}/{name}")
    got = out.collect()
    assert sorted(str(r.doc_id) for r in got if r.reading == 1) == sorted(str(d) for d, _, _ in here)
    sizes: dict = {}
    for _, t, s in here:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    assert sum(r.taken for r in got) == pytest.approx(sum(brute_targets(sizes).values()), abs=len(sizes))
    again = corpus_pipeline.run(spark, path).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("kind", ["empty", "unlabelled"])
def test_pipeline_without_rows_or_labels(spark, folder, tmp_path, kind):
    path = str(tmp_path)
    rows = [] if kind == "empty" else [(d, t, None, s) for d, t, _, s in odd_rows()]
    write(spark, rows, f"{path}/documents.parquet")
    spark.read.parquet(f"{folder[0]}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the corpus tables")
@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(q.ORACLE_SQL[name])
    columns = sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    df = q.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(x[i] for i in at)) for x in want.fetchall())
