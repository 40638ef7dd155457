"""Suffix and chunk dedup, Jaccard join, components."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from mailtriage.llm import chunk_dedup, components, jaccard_join, suffix_dedup
from mailtriage.llm.cutting import merged

from .fixtures import odd_rows, prose, shingles


def brute_windows(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        kept = bytes(c for c, m in zip(t, mask, strict=True) if not m)
        runs = sum(m and (i == 0 or not mask[i - 1]) for i, m in enumerate(mask))
        out.append((len(t), sum(mask), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(odd, none):
    rows = odd_rows()
    want = Counter((d, *w) for (d, *_), w in zip(rows, brute_windows([(t or "").encode() for _, t, *_ in rows], 200), strict=True))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(odd).collect())
    assert got == want
    assert suffix_dedup.deduplicate(none).count() == 0


def test_suffix_dedup_small_windows(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 120))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {(i, *w) for i, w in enumerate(brute_windows([t.encode() for t in texts], 12))}
    for step in (1, 5):
        spans = suffix_dedup.repeated_spans(docs, 12, 4, step)
        got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_spans(docs, spans).collect()}
        assert got == want


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 1000, 500).astype(np.uint64)
    for width in (1, 2, 7, 500):
        assert suffix_dedup.sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(500 - width + 1)]


def test_gear_forgets():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 400).astype(np.uint8)
    h = 0
    plain = []
    for b in data.tolist():
        h = (2 * h + int(chunk_dedup._GEAR[b])) % 2**32
        plain.append(h)
    assert chunk_dedup.gear(data).tolist() == plain


def test_cuts_resist_insertions():
    rng = random.Random(4)
    text = prose(rng, 500).encode()
    ends = chunk_dedup.cuts(text)
    assert ends[-1] == len(text) and all(0 < b - a <= chunk_dedup.MOST for a, b in zip([0, *ends], ends, strict=False))
    pieces = {text[a:b] for a, b in zip([0, *ends], ends, strict=False)}
    moved = b"inserted " + text
    after = chunk_dedup.cuts(moved)
    same = {moved[a:b] for a, b in zip([0, *after], after, strict=False)} & pieces
    assert len(same) > 0.9 * len(pieces)
    assert chunk_dedup.cuts(b"") == []


def test_chunk_dedup(odd, none, spark):
    got = chunk_dedup.deduplicate(odd).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert r.n_bytes - r.n_removed == len(r.kept) and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
        assert r.n_spans == len(r.spans)
    rng = random.Random(8)
    passages = [prose(rng, 60) for _ in range(20)]
    docs = [(i, prose(rng, 100) + " " + passages[i % 20] + " " + prose(rng, 100)) for i in range(60)]
    rows = {r.doc_id: r for r in chunk_dedup.deduplicate(spark.createDataFrame([*docs, (99, prose(rng, 300))], "doc_id long, text string")).collect()}
    assert all(rows[i].n_removed == 0 for i in [*range(20), 99])  # the first copy stays, clean ones too
    assert sum(rows[i].n_removed > 100 for i in range(20, 60)) >= 38
    assert chunk_dedup.deduplicate(none).count() == 0


def brute_chunks(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row: the first of equal chunks stays.
    Rows of one id and text are one document."""
    docs = sorted({(d, t) for d, t in rows}, key=lambda x: (x[0], spark_hash(x)))
    seen, out = {}, {}
    for doc in docs:
        data, last, gone, kept, spans = doc[1], 0, 0, [], []
        for end in chunk_dedup.cuts(data):
            piece = data[last:end]
            if seen.setdefault(piece, (doc, last)) == (doc, last):
                kept.append(piece)
            else:
                gone += len(piece)
                if spans and spans[-1][1] == last:
                    spans[-1][1] = end
                else:
                    spans.append([last, end])
            last = end
        out[doc] = (doc[0], len(data), gone, len(spans), hashlib.sha256(b"".join(kept)).hexdigest())
    return Counter(out[x] for x in rows)


def spark_hash(doc):
    return 0  # ids of different texts are left out of the comparison


def test_chunk_dedup_brute(odd, spark):
    known = [(d, (t or "").encode()) for d, t, *_ in odd_rows() if d is not None and d != 7]
    table = odd.where("doc_id is not null and doc_id <> 7")
    rng = random.Random(31)
    passages = [prose(rng, rng.randint(20, 90)) for _ in range(12)]
    more = [(1000 + i, " ".join(rng.choice(passages) if rng.random() < 0.4 else prose(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 9)))) for i in range(120)]
    more += [(2000 + i, "q" * n) for i, n in enumerate((1, 22, 511, 512, 513, 534, 535, 1024, 5000, 5000))]
    for df, rows in ((table, known), (spark.createDataFrame(more, "doc_id long, text string").repartition(4), [(d, t.encode()) for d, t in more])):
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in chunk_dedup.deduplicate(df).collect())
        assert got == brute_chunks(rows)
    for _, t in more:
        ends = [0, *chunk_dedup.cuts(t.encode())]
        assert len(ends) < 3 or min(b - a for a, b in zip(ends, ends[1:], strict=False)) > chunk_dedup.REACH - 1


def test_chunk_dedup_short_passages(spark):
    """Passages of 51 words lose most of their bytes in any surroundings, short whole copies all."""
    rng = random.Random(15)
    docs, passages = [], [prose(rng, 51) for _ in range(300)]
    for i in range(600):
        docs.append((i, f"{prose(rng, rng.randint(1, 40))} {passages[i % 300]} {prose(rng, rng.randint(1, 40))}"))
    short = ["x", "two words", prose(rng, 9), prose(rng, 18), "é" * 30]
    docs += [(1000 + i, short[i % 5]) for i in range(10)] + [(2000, "x" + prose(rng, 40))]
    rows = {r.doc_id: r for r in chunk_dedup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    gone = [rows[i].n_removed / len(passages[i - 300]) for i in range(300, 600)]
    assert min(gone) > 0 and sum(gone) > 0.7 * len(gone)
    assert all(rows[i].n_removed == 0 for i in [*range(300), *range(1000, 1005), 2000])
    assert all(rows[i].n_removed == rows[i].n_bytes for i in range(1005, 1010))


def test_cuts_depend_on_near_bytes():
    rng = random.Random(16)
    passage = prose(rng, 51).encode()
    near = chunk_dedup.REACH + chunk_dedup.WINDOW
    for _ in range(50):
        found = set()
        for _ in range(2):
            before = prose(rng, rng.randint(1, 90)).encode()
            ends = [e - len(before) for e in chunk_dedup.cuts(before + passage + prose(rng, 20).encode())]
            found.add(tuple(e for e in ends if near < e < len(passage) - near))
        assert len(found) == 1


def test_merged():
    assert merged([{"start": 5, "end": 9}, {"start": 1, "end": 5}, {"start": 20, "end": 21}]) == [(1, 9), (20, 21)]


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)] + [(500 + i, 500) for i in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r.node: r.label for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(docs, k, num, den):
    """component of each id: links over rows that have one."""
    sets = [(d, frozenset(shingles(t, k))) for d, t in docs if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in parent}


def check(spark, docs, k, num, den):
    want = brute_links(docs, k, num, den)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = jaccard_join.similar_documents(table, k, num, den).collect()
    assert len(rows) == len(docs)
    sizes = Counter((d, len(set(shingles(t, k)))) for d, t in docs)
    assert Counter((r.doc_id, r.n_shingles) for r in rows) == sizes
    for r in rows:
        assert r.component_id == want.get(r.doc_id)


def test_jaccard_join_odd(odd, none, spark):
    docs = [(d, t) for d, t, *_ in odd_rows() if d != 7]  # one id with two texts is tested below
    check(spark, docs, 3, 90, 100)
    assert jaccard_join.similar_documents(none, 3, 90, 100).count() == 0
    table = spark.createDataFrame([(7, "one text"), (7, "quite another text"), (8, "one text")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_join.similar_documents(table, 3, 90, 100).collect()} == {(7, 7), (8, 7)}


def test_jaccard_join_dense(spark, monkeypatch):
    """Many copies near the threshold, most of them not linked with the least of their cell."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    rng = random.Random(11)
    docs = []
    for g in range(4):
        base = prose(rng, (60, 150, 30, 12)[g]).split(" ")
        for _ in range(45):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 40)):
                at = rng.randrange(len(w))
                w[at] = rng.choice(("new", "word", "here"))
            if rng.random() < 0.2:
                w = w[: -rng.randint(1, 5)]
            docs.append((len(docs) * 7 % 181, " ".join(w)))
    check(spark, docs, 3, 90, 100)
    check(spark, docs, 5, 80, 100)


def test_tree_loses_no_pair():
    """Links among sets around one centre, against all pairs, in one block and across two sides."""
    rng = np.random.default_rng(3)
    limit = jaccard_join.Threshold(90, 100)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    edits = [rng.integers(0, 2**63, 9).astype(np.uint64) for _ in range(12)]
    sets = []
    for _ in range(150):
        gone = rng.choice(len(base), rng.integers(0, 14), replace=False)
        own = [edits[i] for i in rng.choice(12, rng.integers(0, 3), replace=False)]
        sets.append(np.unique(np.concatenate([np.delete(base, gone), *own])))
    flips = [np.setxor1d(s, base) for s in sets]
    sizes, label = np.array([len(s) for s in sets]), rng.integers(0, 40, 150)
    points = np.array([jaccard_join.point(f) for f in flips])
    for side in (np.full(150, 2), rng.integers(0, 2, 150)):
        want = set()
        for j in range(150):
            for i in range(j):
                both = len(np.intersect1d(sets[i], sets[j]))
                if label[i] != label[j] and (side[i] != side[j] or side[i] == 2) and 100 * both >= 90 * (sizes[i] + sizes[j] - both):
                    want.add((i, j))
        found = list(jaccard_join.tree_pairs(points, sizes, side, label, limit))
        linked = {tuple(sorted((i, j))) for i, j, share in found if len(np.intersect1d(flips[i], flips[j])) >= share}
        assert len({tuple(sorted(x[:2])) for x in found}) == len(found)
        assert linked == want and len(want) > 20
        few = jaccard_join.joins(flips, sizes, side, label, limit)
        assert len(few) < 40 and {tuple(sorted(x)) for x in few} <= want


def test_cells_meet():
    """Sets that link share more cells than either leaves out, at many sizes and both thresholds."""
    rng = np.random.default_rng(5)
    for num, den in ((90, 100), (80, 100), (50, 100)):
        limit = jaccard_join.Threshold(num, den)
        for n in [*range(1, 40), 100, 333, 1000]:
            s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            for _ in range(6):
                drop, add = rng.integers(0, n // 5 + 1), rng.integers(0, n // 5 + 1)
                t = np.unique(np.concatenate((rng.permutation(s)[drop:], rng.integers(0, 2**63, add).astype(np.uint64))))
                both = len(np.intersect1d(s, t))
                if len(t) and den * both >= num * (len(s) + len(t) - both) and not np.array_equal(s, t):
                    own, other = (dict(zip(limit.classes(len(x)), jaccard_join.cells_of(x, limit), strict=True)) for x in (s, t))
                    met = [len(set(own[c][1].tolist()) & set(other[c][1].tolist())) > max(own[c][0], other[c][0]) for c in own.keys() & other.keys()]
                    assert any(met)


def test_one_of_each(odd):
    kept = jaccard_join.one_of_each(odd, 3, 90, 100)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    want = defaultdict(set)
    for d, t, *_ in odd_rows():
        want[d].add(t)
    assert None in ids and len(set(ids)) < len(want)
