"""Quality classifier, source divergence, conversation repair."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mailtriage.llm import conversation_repair, divergence, quality, queries

from .fixtures import odd_rows, prose

SF = "/root/testdata/sf0.01"


# Conversation repair


def plain_repair(rows):
    """Counts, cost, audit and text of a conversation's rows (turn, role, text) in order, by trying all edits."""
    kinds, seen = [], set()
    for _, role, text in rows:
        shown = re.sub("[\x20\x09-\x0d]+$", "", text)
        kind = "blank" if not re.search("[^\x20\x09-\x0d]", text) else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)

    def fits(roles):
        return re.fullmatch("(s?(ua)+)?", roles) is not None or any(re.fullmatch("(s?(ua)+)?", roles + tail) for tail in ("ua", "a"))

    @functools.cache
    def best(i, roles, inserted):
        """roles: the last two initials are enough; inserted: inserts in a row before row i."""
        ways = []
        if i == len(rows) and re.fullmatch("s?(ua)+|", roles):
            ways.append((0, "", ()))
        if inserted < 3:
            for name in ("user", "assistant"):
                if fits(roles + name[0]):
                    cost, audit, lines = best(i, short(roles + name[0]), inserted + 1)
                    ways.append((2 + cost, "I" + audit, (name + ":", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, lines = best(i + 1, roles, 0)
            ways.append((3 + cost, "D" + audit, lines))
            if kinds[i] not in ("blank", "duplicate"):
                for edit, name in (("K", role), ("R", "user"), ("R", "assistant")):
                    if fits(roles + name[:1]) and name[:1]:
                        cost, audit, lines = best(i + 1, short(roles + name[:1]), 0)
                        ways.append(((edit == "R") * 2 + (kinds[i] == "truncated") + cost, edit + audit, (f"{name}:{text}", *lines)))
        return min(ways, default=(10**9, "", ()))

    def short(roles):
        return roles if len(roles) < 5 else roles[:-2]

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, *_ in rows if t is not None]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), "\n".join(lines),
    )


def plain_damage(rows):
    """Rows by conversation after damage, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out[conv] += [] if k == 0 else [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def conversations():
    rng = random.Random(13)
    rows = []
    for conv in range(300):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "No", "yes? ", "", " \n", None, f"Word {turn}.", f"Word {turn}", "é東\n.", "\x85"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None, 0]), role, text))
    rows += [(None, 1, "user", "A."), (None, None, None, None), (None, 2, "assistant", "B."), rows[0], rows[0]]
    lone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    return rows + [(lone, 1, "user", "gone.")], lone


def table(spark, rows):
    full = [(*r, "x", "y", True) for r in rows]
    return spark.createDataFrame(full, "conv_id long, turn long, role string, text string, audit string, repeated string, gone boolean").repartition(5)


FIELDS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


@pytest.mark.parametrize("block", [512, 1, 3])
def test_repair_against_all_edits(spark, monkeypatch, block):
    rows, lone = conversations()
    want = {c: plain_repair(r) for c, r in plain_damage(rows).items()}
    if block == 512:
        found = conversation_repair.repair(conversation_repair.damage(table(spark, rows)), lost="lost").collect()
        got = {r.conv_id: (*(r[f] for f in FIELDS), r.repaired) for r in found}
        assert len(found) == len(got) and got == want
        assert got[lone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), "")
    else:  # small blocks: the cut of a conversation does not show
        monkeypatch.setattr(conversation_repair, "BLOCK", block)
        for conv, own in plain_damage(rows).items():
            one, seen = conversation_repair._Conversation(conv, True), set()
            for turn, role, text in own:
                one.add(turn, role, text, (role, text) in seen)
                seen.add((role, text))
            assert one.result()[1:] == want[conv], own


def test_repair_of_a_long_conversation(spark):
    rng = random.Random(4)
    rows = [(5, t, rng.choice(["user", "assistant"]), f"text {t}" + rng.choice([".", ""])) for t in range(4000)]
    found = conversation_repair.repair(table(spark, rows)).collect()
    assert len(found) == 1 and len(found[0].audit.replace("I", "")) == 4000
    roles = "".join(line[0] for line in found[0].repaired.split("\n"))
    assert re.fullmatch("(s?(ua)+)?", roles) and found[0].gaps == 0
    # Neighbours repeat a role at random: the cost follows a plain Viterbi pass over costs alone.
    costs = {0: 0}
    for _, _, role, text in rows:
        cut = not text.endswith(".")
        after = {}
        for s, c in costs.items():
            for put in range(2):  # an insert before the row
                s2, c2 = (s, c) if not put else ((2, c + 2) if s != 2 else (3, c + 2))
                wanted = 3 if s2 == 2 else 2
                for to, more in ((s2, 3), (wanted, cut if role == ("assistant" if wanted == 3 else "user") else 2 + cut)):
                    after[to] = min(after.get(to, 10**9), c2 + more)
        costs = after
    assert found[0].cost == min(costs.get(0, 10**9), costs.get(3, 10**9), costs.get(2, 10**9) + 2)


def test_repair_edges(spark):
    none = table(spark, [])
    assert conversation_repair.repair(none).count() == 0 and conversation_repair.damage(none).count() == 0
    whole = table(spark, [(1, 0, "system", "S."), (1, 1, "user", "q?"), (1, 2, "assistant", "a!\n"), (2, 0, "user", "x" * 3_000_000 + ".")])
    found = {r.conv_id: r for r in conversation_repair.repair(whole).collect()}
    assert found[1].audit == "KKK" and found[1].cost == 0 and found[1].repaired == "system:S.\nuser:q?\nassistant:a!\n"
    assert found[2].audit == "KI" and found[2].cost == 2
    assert "repaired" not in conversation_repair.repair(whole, with_text=False).columns


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: plain_repair(r)[:-1] for c, r in plain_damage(rows).items()}
    found = queries.op13_conversation_repair(spark, SF).collect()
    assert {r.conv_id: tuple(r[f] for f in FIELDS) for r in found} == want and len(found) == len(want)


# Source divergence


def plain_divergence(rows, least=3):
    terms, groups, in_docs = defaultdict(Counter), set(), defaultdict(Counter)
    for lang, source, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        groups.add((lang or "", source or ""))
        terms[lang or "", source or ""].update(found)
        in_docs[lang or ""].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in in_docs[lang].items() if n >= least), key=str.encode)
        own = {s: terms[g, s] for g, s in groups if g == lang}

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in own.items()}, share(sum(own.values(), Counter()))
        for s in own:
            pairs = sorted(((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in own if o != s))
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)}
            single = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t])
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(single[:200], 1)}
    return out


def found_divergence(df):
    rows = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_divergence_odd_rows(spark, odd, none):
    rows = [(r[2], r[3], r[1]) for r in odd_rows()]
    assert found_divergence(divergence.compare(odd)) == plain_divergence(rows)
    assert divergence.compare(none).count() == 0


def test_divergence_chunks(spark, monkeypatch):
    rng = random.Random(8)
    words = [prose(rng, 1) for _ in range(150)] + ["É", "é", "zz東", "Ａ", "ab\x7fcd", "it's"]
    rows = [(rng.choice(["x", "y", None]), rng.choice(["s1", "s2", "", None, "é"]), " ".join(rng.choices(words, k=rng.randint(0, 40)))) for _ in range(400)]
    rows += [("lone", "a", "one two"), ("lone", "b", "three"), ("single", "a", "w w w"), ("single", "a", "w"), ("single", "a", "w")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, rank int").repartition(7)
    want = plain_divergence(rows)
    assert ("lone", "a", "pair", "b", 0, 1) in want
    for name, value in (("CHUNK_TERMS", 7), ("CHUNK_COUNTS", 20), ("CELLS", 10), ("HELD", 50), ("TOP_TERMS", 200)):
        monkeypatch.setattr(divergence, name, value)
    assert found_divergence(divergence.compare(docs)) == want


def test_divergence_of_large_counts():
    counts = np.array([0, 5, 2**40, 2**50], np.int64)
    assert divergence.shares(counts, 2**51, 4).tolist() == [1 + 10**9 * (int(c) + 1) // (2**51 + 4) for c in counts]


def test_divergence_ranks_stop(spark):
    rows = [("en", "a", " ".join("w" + "abcdefghij"[i % 10] * (i // 10 + 1) for i in range(300)))] * 3 + [("en", "b", "other words")] * 3
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    found = found_divergence(divergence.compare(docs))
    assert found == plain_divergence(rows) and max(r[-1] for r in found) == 200


def test_divergence_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = set(con.execute("select lang, source, part, item, value, rank from (" + queries.ORACLE_SQL["op12_source_divergence"] + ")").fetchall())
    assert found_divergence(queries.op12_source_divergence(spark, SF)) == want


# Quality classifier


def plain_features(text):
    """Counts of a text's features by kind, without hashing."""
    raw = re.sub(b"[\x09-\x0d]", b" ", text.encode())
    words = raw.split(b" ")
    words = [w for w in words if w]
    shown = b" " + raw + b" "
    grams = [shown[i : i + n] for n in (3, 4, 5) for i in range(len(shown) - n + 1) if b" " not in shown[i + 1 : i + n - 1]]
    return len(grams) + len(words), sum(a == b for a, b in zip(words, words[1:], strict=False))


@pytest.mark.parametrize("text", ["", " ", "a", "ab ab ab", "  x \n y\ty y  ", "word. Word. word.", "é 東京東京 東京東京"])
def test_features(text):
    found = list(quality.features([text.encode()]))
    n, repeats = plain_features(text)
    assert sum(len(b) for b, _ in found[:-1]) == n and len(found[-1][0]) == repeats
    both = list(quality.features([text.encode(), b"word. next", text.encode()]))
    for (one, _), (all_of, begins) in zip(found, both, strict=True):
        assert all_of[: begins[1]].tolist() == one.tolist() and all_of[begins[2] :].tolist() == one.tolist()


def test_pieces(monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 16)
    for text in (b"", b"short", b"many words of some length here", b"x" * 50, b" " * 40, b"a " * 30):
        found = list(quality.pieces(text))
        assert b"".join(found) == text and all(len(p) <= 16 for p in found)


def labelled(spark):
    rng = random.Random(21)
    texts, marks = [], []
    for i in range(500):
        words = [prose(rng, 1) for _ in range(rng.randint(20, 80))]
        good = i % 4 != 0
        texts.append(" ".join(words) if good else " ".join(w.upper() + "!!" for w in words) if i % 8 else " ".join(w for w in words for _ in range(4)))
        marks.append(int(good))
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \n"), (None, texts[0]), (1, texts[1]), (903, "long words " * 200_000), (904, "x" * 3_000_000)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, label string").repartition(3)
    marks = [(i, m) for i, m in enumerate(marks)] + [(3, None), (None, 1), (7777, 1), (5, 2), (1, 1), (900, 1)]
    return docs, spark.createDataFrame(marks, "doc_id long, quality int"), rows, dict(marks[:500])


def test_quality(spark):
    docs, labels, rows, truth = labelled(spark)
    model = quality.train(docs, labels)
    found = quality.score(docs, model).collect()
    assert Counter(r.doc_id for r in found) == Counter(d for d, _ in rows)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    empty = {r.score for r in found if r.doc_id in (900, 901, 902)}
    assert len(empty) == 1
    again = quality.score(docs, quality.train(docs, labels)).collect()
    assert {(r.doc_id, r.score) for r in again} == {(r.doc_id, r.score) for r in found}


def test_quality_learns_nothing_from_held_out_rows(spark):
    docs, labels, _, _ = labelled(spark)
    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_quality_sample_is_bounded(spark):
    docs, labels, _, _ = labelled(spark)
    found = Counter(r.label for r in quality.sample(docs, labels, "quality", 20).collect())
    assert found == {0: 20, 1: 20}


def test_quality_without_rows(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    found = quality.score(odd, quality.train(odd, empty)).collect()
    assert len(found) == len(odd_rows()) and all(r.score == 0.5 and r.predicted == 1 for r in found)
    one_sided = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in quality.score(odd, quality.train(odd, one_sided)).collect())
    assert quality.score(none, quality.train(none, empty)).count() == 0


def test_quality_query(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in queries.op11_quality_classifier(spark, SF).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
