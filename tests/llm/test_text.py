"""Token counts, language ID, decontamination, chat."""

import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mailtriage.llm import chat, decontamination, language_id, tokens

from .fixtures import odd_rows, prose, shingles

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts(odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    want = Counter()
    for d, t, *_ in odd_rows():
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want[d, len((t or "").encode()), n, n > 512] += 1
    assert Counter(tuple(r) for r in tokens.count_tokens(odd, BPE).collect()) == want
    assert tokens.count_tokens(none, BPE).count() == 0


def test_proof():
    proof = tokens.prove(BPE)
    assert " the" in proof.whole and "<|endoftext|>" not in proof.whole and proof.special == ("<|endoftext|>",)


def two_languages(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(400):
        a = i % 2
        alphabet = "abcdelnrst" if a else "oukmzwvgyp"
        text = " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 8))) for _ in range(60))
        rows.append((i, text, "xa" if a else "xb"))
    rows += [(900, None, "xa"), (901, "12 !!", None), (902, "", "xb"), (None, rows[0][1], "xa"), (903, "日本語の文章です" * 40, None), (904, "é", None)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(path)
    return spark.read.parquet(path), rows


@pytest.mark.parametrize("texts", [1, 2, 3, 9])
def test_language_with_few_texts_rejects_as_others_do(spark, tmp_path, texts):
    """A language learned from a few texts has a limit of its own, or the others'."""
    import random

    rng = random.Random(17)

    def text(alphabet, words=80):
        return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 8))) for _ in range(words))

    learned = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, text("abcdelnrst"), "many") for i in learned[:120]] + [(i, text("oukmzwvgyp"), "few") for i in learned[120 : 120 + texts]]
    extra = [(5000, text("oukmzwvgyp"), None), (5001, text("oukmzwvgyp"), None), (5002, text("абвгдежзик"), None), (5003, text("abcdelnrst"), None)]
    path = str(tmp_path / "few")
    spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").write.parquet(path)
    docs = spark.read.parquet(path)
    model = language_id.train(docs)
    assert model.languages == ["few", "many"] and all(0 < m < 20 and d > 0 for m, d in model.limits)
    found = {r.doc_id: r for r in language_id.identify(docs, model).where("doc_id >= 5000").collect()}
    assert found[5000].lang_pred == found[5001].lang_pred == "few" and found[5003].lang_pred == "many" and found[5003].accepted
    if texts >= 3:
        assert found[5000].accepted and found[5001].accepted and not found[5002].accepted


def test_one_language_of_one_text(spark, none):
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    docs = spark.createDataFrame([(one, "only this text", "xx"), (200, "another one", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.limits == [(float("inf"), 0.0)] and language_id.keep_identified(docs, model).count() == 2


def test_language_id(spark, tmp_path, none):
    docs, rows = two_languages(spark, tmp_path)
    model = language_id.train(docs)
    found = language_id.identify(docs, model).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    truth = {d: lang for d, _, lang in rows}
    for d, r in by.items():
        assert r.held_out == (d is None or zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    plain = [by[i] for i in range(400)]
    assert sum(r.lang_pred == truth[r.doc_id] for r in plain if r.held_out) >= 0.98 * sum(r.held_out for r in plain)
    assert all(r.accepted for r in plain)
    assert {by[d].lang_pred for d in (900, 901, 902)} == {"und"} and not by[903].accepted
    kept = {r.doc_id for r in language_id.keep_identified(docs, model).collect()}
    assert set(range(400)) <= kept and not kept & {900, 901, 902, 903}
    empty = language_id.train(none)
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}
    assert language_id.identify(none, model).count() == 0


def test_kneser_ney_sums_to_one(spark, tmp_path):
    import numpy as np

    docs, _ = two_languages(spark, tmp_path)
    model = language_id.train(docs)
    text = "abcd"
    alphabet = "abcdelnrst " + "oukmzwvgyp"
    total = 0.0
    for c in alphabet:
        codes = language_id.letters(text + c)[1:-1] if c != " " else np.append(language_id.letters(text)[1:-1], np.uint32(32))
        h = language_id.grams(codes)
        b = language_id.contexts(h, np.zeros(1, np.int64))
        total += float(np.exp(model.models[model.languages.index("xa")].log_p([x[-1:] for x in h], [x[-1:] for x in b])[0]))
    assert total == pytest.approx(1.0, abs=0.06)  # one more letter of the alphabet is left for the unseen


PAD = chr(31)  # stands before a text


class PlainKneserNey:
    """Interpolated Kneser-Ney over dicts of strings, one language."""

    def __init__(self, texts, order, discount, alphabet):
        self.order, self.discount, self.alphabet = order, discount, alphabet
        counts = [Counter() for _ in range(order + 1)]
        for text in texts:
            padded = PAD * order + text
            for i in range(order, len(padded)):
                for k in range(1, order + 1):
                    counts[k][padded[i - k + 1 : i + 1]] += 1
        for k in range(1, order):
            before = Counter(g[1:] for g in counts[k + 1])
            counts[k] = Counter({g: before.get(g, 1) for g in counts[k]})
        self.counts = counts
        self.sums, self.types = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
        for k in range(1, order + 1):
            for g, n in counts[k].items():
                self.sums[k][g[:-1]] += n
                self.types[k][g[:-1]] += 1

    def entropy(self, text):
        import math

        padded, total = PAD * self.order + text, 0.0
        for i in range(self.order, len(padded)):
            p = 1 / self.alphabet
            for k in range(1, self.order + 1):
                g = padded[i - k + 1 : i + 1]
                if self.sums[k][g[:-1]]:
                    s = self.sums[k][g[:-1]]
                    p = max(self.counts[k][g] - self.discount, 0) / s + self.discount * self.types[k][g[:-1]] / s * p
            total -= math.log(p)
        return total / len(text)


def test_entropies_are_plain_kneser_ney(spark, tmp_path):
    docs, rows = two_languages(spark, tmp_path)
    model = language_id.train(docs)
    drawn = language_id.sample(docs).where("part <> 0").collect()
    as_text = lambda t: "".join(map(chr, language_id.letters(t)))
    by = {lang: [as_text(r.text) for r in drawn if r.lang == lang] for lang in model.languages}
    alphabet = sum(len(set(" ".join(t) + " ")) for t in by.values()) + 1
    plain = [PlainKneserNey(by[lang], language_id.ORDER, language_id.DISCOUNT, alphabet) for lang in model.languages]
    texts = [t for _, t, _ in rows[:30] if t] + ["abcde", "zzz", "日本語", "a é b"]
    got, _ = model.entropies(texts)
    for text, mine in zip(texts, got, strict=True):
        want = [m.entropy(as_text(text)) for m in plain]
        assert mine.tolist() == pytest.approx(want, rel=1e-4)
        if len(text) > 5:
            assert model.predict([text])[0][0] == model.languages[want.index(min(want))]


def test_pieces_carry_their_context(spark, tmp_path, monkeypatch):
    docs, rows = two_languages(spark, tmp_path)
    model = language_id.train(docs)
    texts = [rows[0][1] * 20, rows[1][1], "abc"]
    want = model.entropies(texts)[0]
    monkeypatch.setattr(language_id, "PIECE", 97)
    assert model.entropies(texts)[0] == pytest.approx(want, rel=1e-6)


def test_numbers_are_no_letters(odd, spark):
    assert [len(language_id.letters(t)) for t in ("½", "²", "Ⅷ", "①", "12", "_", "")] == [0] * 7
    assert "".join(map(chr, language_id.letters("aⅧb ² c½"))) == " a b c "
    found = language_id.identify(odd, language_id.train(odd)).collect()
    assert len(found) == len(odd_rows())
    blank = {d for d, t, *_ in odd_rows() if not any(c.isalpha() for c in t or "")}
    assert all(r.lang_pred == "und" for r in found if r.doc_id in blank and r.doc_id is not None)


def brute_contamination(docs, items):
    found = {}
    for d, text in docs:
        for i, item in items:
            bag = Counter(shingles(item, 5))
            mine = shingles(text, 5)
            if not bag or not mine or len(mine) < 0.8 * bag.total():
                continue
            m = min(bag.total(), len(mine))
            for a in range(len(mine) - m + 1):
                c = Counter(mine[a : a + m])
                same = sum((c & bag).values())
                alike = same / (c.total() + bag.total() - same)
                if alike >= 0.8 and alike > found.get((d, i), 0):
                    found[d, i] = alike
    return found


def test_decontamination(spark, odd, none):
    import random

    rng = random.Random(9)
    items = [(n, prose(rng, n)) for n in (15, 20, 20, 33, 60, 110)]
    items = [(i, t) for i, (_, t) in enumerate(items)] + [(90, None), (91, ""), (92, "one two three"), (93, "x"), (None, "no id but seven words in it here")]
    docs = []
    for i in range(60):
        words = prose(rng, rng.randint(40, 300)).split(" ")
        if i % 3 == 0:
            item = items[i % 6][1].split(" ")
            if i % 2:
                item[len(item) // 2] = "edited"
            if i % 5 == 0:
                item = item[: int(0.93 * len(item))]
            words[i : i] = item
        docs.append((i, " ".join(words)))
    docs += [(100, items[5][1]), (101, " ".join(items[5][1].split(" ")[:100])), (102, "one two three"), (103, None), (104, ""), (None, items[0][1].upper()), (105, "x")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, block string")
    want = {k: v for k, v in brute_contamination([(d, t or "") for d, t in docs], [(i, t or "") for i, t in items]).items()}
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.find_contamination(table, bench).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    blocks = {(r.doc_id, r.item_id): r.similarity for r in decontamination.find_contamination(table, bench, block_bytes=200).collect()}
    assert blocks == got
    kept = decontamination.drop_contaminated(table, bench)
    hit = {d for d, _ in got}
    assert sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(str(d) for d, _ in docs if d not in hit)
    assert decontamination.find_contamination(none, bench).count() == 0
    assert decontamination.find_contamination(odd, none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_decontamination_near_the_threshold():
    """Items with an edited word or a cut end, just above the least similarity; none is lost."""
    import random

    rng = random.Random(12)
    items, texts = [], []
    for i in range(400):
        item = prose(rng, rng.randint(16, 59)).split(" ")
        if i % 10 == 0:
            item = (item[:6] * 12)[: len(item)]
        items.append((i, " ".join(item)))
        m = len(item) - 4
        gone = m - -(-8 * 2 * m // 18)  # so many shingles may differ
        if gone >= 5 and i % 2:
            item[rng.randrange(5, len(item) - 5)] = "edited"
            gone -= 5
        item = item[min(gone, 4) :]
        texts.append(" ".join([prose(rng, 80), *item, prose(rng, 80)]) if i % 3 else " ".join(item))
    got = {(texts[t], item): s for t, item, s, _ in decontamination.Index(items).matches(texts)}
    want = {(texts[i], i): s for i, item in items for s in brute_contamination([(i, texts[i])], [(i, item)]).values()}
    assert sum(s < 0.85 for s in want.values()) > 200
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    edited = [prose(rng, rng.choice((49, 54))).split(" ") for _ in range(800)]
    changed = [" ".join([*w[: len(w) // 2], "edited", *w[len(w) // 2 + 1 :]]) for w in edited]
    found = decontamination.Index(list(enumerate(map(" ".join, edited)))).matches(changed)
    assert {(t, i) for t, i, *_ in found} == {(i, i) for i in range(800)}
    alone = decontamination.Index(items, radius=3)  # what fingerprints miss, shared shingles find
    assert {(texts[t], item): s for t, item, s, _ in alone.matches(texts)} == got


def test_window_fingerprints():
    import numpy as np

    x = np.random.default_rng(4).integers(0, 2**63, 400).astype(np.uint64)
    padded = np.concatenate((x, np.zeros(60, np.uint64)))
    for m, prints in decontamination.window_fingerprints(padded, [1, 2, 7, 11, 32, 60]):
        assert prints[: 400 - m].tolist() == [decontamination.fingerprint(x[i : i + m]) for i in range(400 - m)]
        long = decontamination.long_fingerprints(np.concatenate((x, np.zeros(m, np.uint64))), m)
        assert long[: 400 - m].tolist() == prints[: 400 - m].tolist()


def test_hamming_blocks_miss_nothing():
    import numpy as np

    rng = np.random.default_rng(1)
    index = decontamination.Index([(0, " ".join(map(str, range(40))))])
    print_of = index.by_length[36][1][0]
    for _ in range(200):
        bits = rng.choice(64, rng.integers(0, 16), replace=False)
        flipped = np.uint64(int(print_of) ^ sum(1 << int(b) for b in bits))
        assert list(index.near(np.array([flipped], np.uint64), 36)) == [(0, 0)]


def test_chat(spark):
    rows = [(1, 2, "bob", "hi <|end|> <\\| x"), (1, 1, "ann", "hello"), (1, 0, "system", "be kind"), (1, 3, None, None), (2, 0, "system", "alone"), (None, 5, "ann", "no id"), (1, 1, "ann", "hello"), (3, None, "a|b\nc", "odd"), (3, 1, "bob", "é😀")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, start string").repartition(4)
    found = chat.perspectives(table).collect()
    views = {}
    for r in found:
        views.setdefault((r.conv_id, r.assistant), []).append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (3, "a|b\nc"), (3, "bob")}
    for (conv, who), own in views.items():
        own.sort(key=lambda r: r.start)
        whole = "".join(r.segment for r in own)
        assert [r.start for r in own] == [0, *[r.end for r in own[:-1]]] and own[-1].end == len(whole)
        assert len(own) == sum(r[0] == conv for r in rows)
        learned = [chat.unquoted(whole[r.learn_from : r.learn_to].removesuffix(chat.END)) for r in own if r.learn_from is not None]
        assert sorted(learned) == sorted((t or "") for c, _, s, t in rows if c == conv and (s or "unknown") == who)
        assert whole.count("<|end|>") == len(own)
    assert chat.perspectives(table.limit(0)).count() == 0
