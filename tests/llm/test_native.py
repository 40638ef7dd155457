"""Exact dedup, secret scan, mixing."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mailtriage.llm import exact_dedup, jaccard_join, mixing, secrets, sketch, suffix_dedup
from mailtriage.llm.trigrams import holds, query_of

from .fixtures import lower, odd_rows, words


def test_exact_groups(odd):
    groups = defaultdict(list)
    for doc_id, text, *_ in odd_rows():
        groups[lower(text)].append(doc_id)
    rows = exact_dedup.exact_groups(odd).collect()
    assert len(rows) == len(odd_rows())
    kept = defaultdict(int)
    for r in rows:
        group = groups[lower(r.text)]
        known = [d for d in group if d is not None]
        assert r.group_size == len(group)
        assert r.keep_id == (max(known) if known else None)
        kept[lower(r.text)] += r.kept
        if r.kept:
            assert r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and set(kept) == set(groups)


def test_drop_exact_copies(odd, none):
    rows = exact_dedup.drop_exact_copies(odd)
    assert rows.columns == odd.columns
    assert rows.count() == len({lower(t) for _, t, *_ in odd_rows()})
    assert exact_dedup.drop_exact_copies(none).count() == 0
    assert exact_dedup.exact_groups(none).count() == 0


def test_new_splits_move_no_decision(spark, tmp_path):
    """The input is split otherwise between the decisions and the scan for the result."""
    texts = [f"text {i % 40} of some" for i in range(60)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6).write.parquet(path)
    split = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(split)
    want = {(i, i % 20 + 40 if i < 20 or i >= 40 else i, 2 if i < 20 or i >= 40 else 1, i >= 20) for i in range(60)}
    try:
        spark.conf.set(split, "4k")
        docs = spark.read.parquet(path)
        rows, left = exact_dedup.exact_groups(docs), exact_dedup.drop_exact_copies(docs)
        spark.conf.set(split, "128m")
        assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows.collect()} == want
        assert sorted(r.doc_id for r in left.collect()) == list(range(20, 60))
    finally:
        spark.conf.set(split, before)


def test_other_columns_outlive_exact_groups(spark):
    names = ["rid", "m_keep", "m_size", "m_kept", "of_row", "of_keep", "row_place", "Of_Size"]
    docs = spark.createDataFrame([(1, "a", *names), (2, "A", *names), (3, "b", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    found = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    assert all([r[n] for n in names] == names for r in found.values())
    assert [(found[i].keep_id, found[i].group_size, found[i].kept) for i in (1, 2, 3)] == [(2, 2, False), (2, 2, True), (3, 1, True)]


def test_short_prefix_still_exact(odd):
    a = {tuple(r) for r in exact_dedup.exact_groups(odd, 1).select("doc_id", "keep_id", "group_size").collect()}
    b = {tuple(r) for r in exact_dedup.exact_groups(odd).select("doc_id", "keep_id", "group_size").collect()}
    assert a == b


def base_spans(text):
    out = []
    for n, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern if rule.kind != "hex" else "[0-9a-f]+", text, re.A):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), n, m.end()))
    return [(secrets.RULES[n].kind, s, e) for s, n, e in sorted(out)]


def test_secrets(odd, none):
    want = sorted(str((d, base_spans(t or ""))) for d, t, *_ in odd_rows())
    rows = secrets.find_secrets(odd).collect()
    got = sorted(str((r.doc_id, [tuple(s) for s in r.secrets])) for r in rows)
    assert got == want
    assert any("access" in g for g in got) and any("hex" in g for g in got)
    assert secrets.find_secrets(none).count() == 0


def test_secrets_many_matches(spark):
    """A text of 100,000 matches, around the block size too."""
    many = ["token=abcdef " * n for n in (secrets.BLOCK - 2, secrets.BLOCK - 1, secrets.BLOCK, 2 * secrets.BLOCK, 100_000)]
    rows = secrets.find_secrets(spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")).collect()
    for r in rows:
        assert [tuple(s) for s in r.secrets] == base_spans(many[r.doc_id])


def test_span_digest(odd):
    rows = secrets.find_secrets(odd).select(secrets.joined(F.col("secrets")).alias("s")).collect()
    assert any(re.fullmatch(r"(assign|access|hex):\d+:\d+(,(assign|access|hex):\d+:\d+)*", r.s) for r in rows)


def test_trigram_queries():
    assert query_of("[0-9a-f]{24,}") is None
    assert query_of("abc|x") is None
    assert query_of("(?:abcd|xyz)+[0-9]") == [frozenset({"abc", "bcd"}), frozenset({"xyz"})]
    assert query_of("ab?c") is None or all(query_of("ab?c"))
    for pattern, texts in {r"api_?key\s*=": ["api_key =", "APIKEY="], r"(foo|ba[rz])qux?": ["fooqu", "barqux", "BAZQU"], r"x{3}y*z": ["xxxz", "xxxyyz"], r"colou?r": ["color", "colour"]}.items():
        for text in texts:
            assert re.search(pattern, text, re.I) and holds(query_of(pattern), text)
        assert not holds(query_of(pattern), "nothing here")


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > 2 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / whole for s in free}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing(odd, none):
    sizes = defaultdict(int)
    for _, t, _, s in odd_rows():
        sizes[s] += len(words(t))
    want = brute_targets(sizes)
    of = odd.select("doc_id", "source", "text").collect()
    rows = mixing.mix(odd, slot_rows=2).collect()
    assert len(rows) == len(of)
    by_target = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        assert r.position is None or 0 <= r.position <= 1
        assert r.position_again is None or r.position_again > r.position or r["size"] == 0
        by_target[round(r.target, 6), r.source_size].append(r)
    for s, target in want.items():
        own = by_target[round(target, 6), sizes[s]]
        assert own, s
        assert abs(sum(r.taken for r in own) - target) <= 0.5 + 1e-9
    again = mixing.mix(odd, slot_rows=2).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(none).count() == 0


def test_positions_follow_demand(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("w " * 10).alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    rows = mixing.training_order(docs).collect()
    known = [r.position for r in rows if r.position is not None]
    assert known == sorted(known)
    heavy = [r.position for r in rows if r.target > 15_000 and r.position is not None]
    assert sum(p < 0.5 for p in heavy) > 0.5 * len(heavy)  # the first kind fades


def numeric_position(demand, target, start, end):
    """When a factor that runs from start to end has used demand of target, by bisection."""
    whole, low, high = (start + end) / 2, 0.0, 1.0
    for _ in range(80):
        t = (low + high) / 2
        if (start * t + (end - start) * t * t / 2) / whole < min(1.0, demand / target):
            low = t
        else:
            high = t
    return (low + high) / 2


def test_positions_invert_the_integral(spark):
    """Positions of both readings are the inverse of the cumulative demand at the middle of the words."""
    rng = random.Random(17)
    rows = [(i, "w " * rng.randint(1, 30), f"s{i % 4}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    names = sorted({s for _, _, s in rows})
    found = {r.doc_id: r for r in mixing.mix(docs, slot_rows=16).collect()}
    for n, source in enumerate(names):
        own = sorted((r for d, _, s in rows if s == source for r in [found[d]]), key=lambda r: (r.position is None, r.position or 0, r.position_again or 0))
        start, end = mixing.SCHEDULE[n % 3]
        read = [r for r in own if r.position is not None]
        begin = 0
        for r in read:
            assert r.position == pytest.approx(numeric_position(begin + r["size"] / 2, r.target, start, end), abs=1e-6)
            if r.position_again is not None:
                assert r.position_again == pytest.approx(numeric_position(begin + r["size"] / 2 + r.source_size, r.target, start, end), abs=1e-6)
            begin += r["size"]
    each = mixing.readings(docs, slot_rows=16).collect()
    assert sum(r.taken for r in each) == sum(r.taken for r in found.values())
    assert sorted((r.doc_id, r.position) for r in each if r.position is not None) == sorted((d, p) for d, r in found.items() for p in (r.position, r.position_again) if p is not None)
    known = [r.position for r in each if r.position is not None]
    assert known == sorted(known) and any(r.reading == 2 for r in each)


def test_hash_is_sha256_of_lowered_text(odd):
    from mailtriage.llm.common import ascii_lower, text_of

    for r in odd.select("text", F.sha2(ascii_lower(text_of()), 256).alias("h")).collect():
        assert r.h == hashlib.sha256(lower(r.text).encode()).hexdigest()


def test_sketch_lets_all_members_pass_and_few_others(spark):
    keys = spark.range(0, 20_000, 2).select(F.xxhash64("id").alias("h"), (F.col("id") % 3).cast("int").alias("d"))
    rows = spark.range(20_000).withColumn("sketch_bits", F.lit("mine"))
    key = F.xxhash64("id")
    passed = sketch.passing(rows, sketch.build(keys, F.col("h")), key)
    assert passed.columns == ["id", "sketch_bits"]
    ids = {r.id for r in passed.collect()}
    assert set(range(0, 20_000, 2)) <= ids and len(ids) < 10_100
    held, bits = sketch.attach(rows, sketch.build(keys, F.col("h"), F.col("d")), key)
    for d in range(3):
        ids = {r.id for r in held.where(sketch.may_hold(bits, key, F.lit(d))).collect()}
        want = {i for i in range(0, 20_000, 2) if i % 3 == d}
        assert want <= ids and len(ids) < len(want) + 100
    assert sketch.passing(rows, sketch.build(keys.limit(0), F.col("h")), key).count() == 0
    nulls = spark.createDataFrame([(None,), (1,)], "k long")
    assert sketch.passing(nulls, sketch.build(nulls.where("k is null"), F.xxhash64("k")), F.xxhash64("k")).where("k is null").count() == 1


def test_full_sketch_changes_no_result(spark, odd, monkeypatch):
    """With hardly any bits every row passes: the exact steps behind the sketch decide alone."""
    columns = ["doc_id", "keep_id", "group_size", "kept"]
    groups = sorted(map(str, exact_dedup.exact_groups(odd).select(*columns).collect()))
    left = sorted(str(r.doc_id) for r in exact_dedup.drop_exact_copies(odd).collect())
    secret = sorted(map(str, secrets.find_secrets(odd).collect()))
    near = sorted(str(r.doc_id) for r in jaccard_join.one_of_each(odd).collect())
    cut = sorted(map(str, suffix_dedup.deduplicate(odd, 20, 8).collect()))
    monkeypatch.setattr(sketch, "BUCKETS", 1)
    monkeypatch.setattr(sketch, "BITS", 2)
    assert sorted(map(str, exact_dedup.exact_groups(odd).select(*columns).collect())) == groups
    assert sorted(str(r.doc_id) for r in exact_dedup.drop_exact_copies(odd).collect()) == left
    assert sorted(map(str, secrets.find_secrets(odd).collect())) == secret
    assert sorted(str(r.doc_id) for r in jaccard_join.one_of_each(odd).collect()) == near
    assert sorted(map(str, suffix_dedup.deduplicate(odd, 20, 8).collect())) == cut


def test_without_drops_the_named_rows_alone(spark):
    rows = spark.createDataFrame([(i % 50 if i % 7 else None, f"t{i}") for i in range(500)], "doc_id long, gone string")
    for ids in ([], [None], [3, 4, 999], [None, *range(25)]):
        gone = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        left = sketch.without(rows, "doc_id", gone)
        assert left.columns == ["doc_id", "gone"]
        assert sorted(map(str, left.collect())) == sorted(str(r) for r in rows.collect() if r.doc_id not in ids)


def test_no_text_is_shuffled_without_broadcast(spark, odd, tmp_path):
    path = str(tmp_path / "docs")
    odd.select("doc_id", "text").write.parquet(path)
    docs = spark.read.parquet(path)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    try:
        spark.conf.set(limit, "-1")
        plan = secrets.find_secrets(docs)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
        plan = exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "kept")._jdf.queryExecution().executedPlan().toString()
        assert "text#" not in plan
    finally:
        spark.conf.set(limit, before)
