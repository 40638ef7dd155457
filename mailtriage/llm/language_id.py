"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-case letters, anything else one blank. Per language an n-gram model is kept as
sorted arrays of 64-bit n-gram hashes with their discounted counts, and of context hashes with their
denominators and back-off weights. A text's language is the one with the lowest cross-entropy per
character. Rejection is calibrated on sample documents that the models have not seen.

Models are fitted on a bounded sample: of each language SAMPLE_DOCS labelled documents at most, whole
texts, of SAMPLE_BYTES together (longer ones are not drawn). Spark counts the n-grams and scores the
calibration documents; the driver gets n-gram counts and a number for each calibration document, both
bounded by the sample and the number of languages. Prediction reads every whole text and shuffles nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of
from .words import mixed

ORDER = 4
DISCOUNT = 0.75
SAMPLE_DOCS = 400
SAMPLE_BYTES = 4 << 20
#: Every CALIBRATE-th sample document is kept from fitting.
CALIBRATE = 4
LEAST_CALIBRATION = 8
#: A document is rejected beyond so many deviations above its language's mean cross-entropy.
DEVIATIONS, LEAST_DEVIATION, FULL_LENGTH = 6.0, 0.15, 400
#: Letters that are scored at a time.
PIECE = 1 << 20
_OTHER = re.compile(r"[\W\d_]+")
#: Numbers that are no digits (fractions, superscripts, Roman numerals) count as word characters above.
_NUMBERS = regex.compile(r"[ \p{N}]*\p{N}[ \p{N}]*")
_P = np.uint64(0xC2B2AE3D27D4EB4F)
_BLANK = 32


def letters(text: str) -> np.ndarray:
    """Code points of the text's lower-case letters between single blanks; empty without a letter."""
    low = _OTHER.sub(" ", text.lower())
    if not low.isascii():
        low = _NUMBERS.sub(" ", low)
    low = low.strip()
    return np.frombuffer(f" {low} ".encode("utf-32-le"), np.uint32) if low else np.zeros(0, np.uint32)


def grams(codes: np.ndarray) -> list[np.ndarray]:
    """For k = 0 to ORDER the hash of the k characters that end at each character; blanks go before."""
    padded = np.concatenate((np.full(ORDER, _BLANK, np.uint64), codes.astype(np.uint64) + np.uint64(1)))
    n, out, raw, power = len(codes), [np.zeros(len(codes), np.uint64)], np.zeros(len(codes), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(ORDER):
            raw = raw + padded[ORDER - k : ORDER - k + n] * power
            power = power * _P
            out.append(mixed(raw + np.uint64(k + 1)))
    return out


def contexts(hashes: list[np.ndarray], first: np.ndarray) -> list[np.ndarray]:
    """For k = 1 to ORDER the hash of the k-1 characters before each character. first: starts of texts."""
    out = []
    start = grams(np.full(1, _BLANK - 1, np.uint32))
    for k in range(ORDER):
        before = np.empty_like(hashes[k])
        before[1:] = hashes[k][:-1]
        before[first] = start[k][0]
        out.append(before)
    return out


@dataclass
class Model:
    """One language: for k = 1 to ORDER sorted gram hashes with discounted counts, sorted context
    hashes with (denominator, weight of the shorter gram)."""

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    floor: float

    def log_p(self, hashes: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(hashes[0]), self.floor)
        for k in range(1, ORDER + 1):
            keys, counts, heads, sums, weights = self.levels[k - 1]
            at, seen = _place(heads, before[k - 1])
            to, has = _place(keys, hashes[k])
            mine = np.where(has, counts[to], 0.0)
            p = np.where(seen, mine / sums[at] + weights[at] * p, p)
        return np.log(p)


def _place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def fit(table: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], alphabet: int) -> Model:
    """From, for k = 1 to ORDER: distinct gram hashes, their context's, their last k-1 characters'
    hash, and their counts. Shorter grams count the distinct characters before them instead."""
    levels: list = [None] * ORDER
    for k in range(ORDER, 0, -1):
        keys, heads, _, counts = table[k - 1]
        if k < ORDER:
            longer = table[k][2]  # the suffix of each gram one longer
            kinds, times = np.unique(longer, return_counts=True)
            at, has = _place(kinds, keys)
            counts = np.where(has, times[at], 1)
        order = np.argsort(keys)
        groups, inverse, types = np.unique(heads, return_inverse=True, return_counts=True)
        sums = np.bincount(inverse, counts)
        levels[k - 1] = (keys[order], np.maximum(counts - DISCOUNT, 0.0)[order], groups, sums, DISCOUNT * types / sums)
    return Model(levels, 1.0 / alphabet)


@dataclass
class Identifier:
    """Models by language with each language's largest accepted cross-entropy as mean and deviation."""

    languages: list[str]
    models: list[Model]
    limits: list[tuple[float, float]]
    slots: int = 1 << 20

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats a character (texts x languages) and length of each text's letters."""
        total, length = np.zeros((len(texts), len(self.models))), np.zeros(len(texts), np.int64)
        held, owners, leads, size = [], [], [], 0
        for i, text in enumerate(texts):
            codes = letters(text)
            length[i] = len(codes)
            for at in range(0, len(codes), PIECE) if self.models else ():
                leads.append(min(at, ORDER))  # the characters before a piece are its context
                held.append(codes[at - leads[-1] : at + PIECE])
                owners.append(i)
                size += len(held[-1])
                if size >= PIECE:
                    self._add(total, held, owners, leads)
                    held, owners, leads, size = [], [], [], 0
        if held:
            self._add(total, held, owners, leads)
        return -total / np.maximum(length, 1)[:, None], length

    def _add(self, total: np.ndarray, held: list[np.ndarray], owners: list[int], leads: list[int]) -> None:
        if not hasattr(self, "_keys"):  # scores of n-grams seen before, by the low bits of their hash
            self._keys, self._kept = np.zeros(self.slots, np.uint64), np.zeros((self.slots, len(self.models)), np.float32)
        first = np.cumsum([0, *map(len, held[:-1])])
        per_text = [grams(x) for x in held]
        hashes = [np.concatenate([x[k] for x in per_text]) for k in range(ORDER + 1)]
        top = hashes[ORDER]
        slot = (top & np.uint64(self.slots - 1)).astype(np.int64)
        scores = self._kept[slot]
        new = np.flatnonzero(self._keys[slot] != top)
        if len(new):
            kinds, where, inverse = np.unique(top[new], return_index=True, return_inverse=True)
            before = contexts(hashes, first)
            at = new[where]
            own, ahead = [h[at] for h in hashes], [b[at] for b in before]
            fresh = np.stack([m.log_p(own, ahead) for m in self.models], axis=1).astype(np.float32)
            scores[new] = fresh[inverse]
            to = slot[at]
            self._keys[to], self._kept[to] = kinds, fresh
            # two kinds for one slot: the last write of either array is the same row's
        for at, lead in zip(first.tolist(), leads, strict=True):
            scores[at : at + lead] = 0
        np.add.at(total, owners, np.add.reduceat(scores.astype(np.float64), first, axis=0))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language or und, score, accepted) of each text."""
        out: list[tuple[str, float, bool]] = []
        entropy, length = self.entropies([t or "" for t in texts])
        for row, n in zip(entropy, length.tolist(), strict=True):
            if not n or not self.models:
                out.append(("und", 0.0, False))
                continue
            best = int(np.argmin(row))
            score = 1.0 / float(np.exp((row[best] - row) * min(n, FULL_LENGTH) / 8).sum())
            mean, deviation = self.limits[best]
            wide = DEVIATIONS * deviation * max(1.0, (FULL_LENGTH / n) ** 0.5)
            out.append((self.languages[best], score, bool(row[best] <= mean + wide)))
        return out


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5


def sample(docs: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, part, text): for each language `most` documents at most, those outside fold 0 with the
    least hash of their id, as long as they stay within SAMPLE_BYTES; part is 0 for those kept for
    calibration. Documents of more than a sixteenth of SAMPLE_BYTES are not drawn.

    A share of each language is drawn first, by hash, so that no language's rows meet in one task.
    """
    from pyspark.sql import Window

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    rows = rows.where(F.octet_length("text") <= SAMPLE_BYTES // 16).select("lang", F.xxhash64(F.col("doc_id"), F.lit("sample")).alias("draw"), "text")
    counts = staged(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")  # a row for each language
    # Twice the share that would do, of hashes spread evenly from 0 to 1.
    near = rows.join(counts, "lang").where(F.pmod("draw", F.lit(1 << 20)) <= (1 << 20) * (2.0 * most + 32) / F.col("n"))
    order = Window.partitionBy("lang").orderBy("draw", "text")
    ranked = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    ranked = ranked.withColumn("bytes", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where(F.col("bytes") <= SAMPLE_BYTES).select("lang", (F.col("place") % CALIBRATE).alias("part"), "text")


def counted(texts: DataFrame, *groups: str) -> DataFrame:
    """groups, k, gram, head, tail, n: the n-grams of texts (groups, text) by group, with the hash of
    their context and of their last k-1 characters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = letters(text)
                if not len(codes):
                    continue
                hashes = grams(codes)
                before = contexts(hashes, np.zeros(1, np.int64))
                for k in range(1, ORDER + 1):
                    kinds, at, times = np.unique(hashes[k], return_index=True, return_counts=True)
                    n = len(kinds)
                    columns = [*(pa.repeat(pa.scalar(x, t), n) for x, t in zip(own, batch.schema.types, strict=False)), pa.array(np.full(n, k, np.int32)), *(pa.array(x.view(np.int64)) for x in (kinds, before[k - 1][at], hashes[k - 1][at])), pa.array(times.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, [*groups, "k", "gram", "head", "tail", "n"])

    schema = ", ".join(f"{g} {texts.schema[g].dataType.simpleString()}" for g in groups)
    rows = texts.select(*groups, "text").mapInArrow(count, f"{schema}, k int, gram bigint, head bigint, tail bigint, n bigint")
    return rows.groupBy(*groups, "k", "gram").agg(F.first("head").alias("head"), F.first("tail").alias("tail"), F.sum("n").alias("n"))


def _fitted(own, alphabet: int) -> Model:
    """The model of a table of n-grams; an n-gram may have several rows, whose counts add up."""
    own = own.groupby(["k", "gram"], sort=False).agg({"head": "first", "tail": "first", "n": "sum"}).reset_index()
    parts = [own[own["k"] == k] for k in range(1, ORDER + 1)]
    return fit([tuple([p[c].to_numpy(np.int64).view(np.uint64) for c in ("gram", "head", "tail")] + [p["n"].to_numpy(np.float64)]) for p in parts], alphabet)


def _entropies(texts: DataFrame, names: Column, found: Identifier):
    """pandas (name, entropy, length): each text under the model of its name. texts: (lang, part, text)."""
    sent = texts.sparkSession.sparkContext.broadcast(found)  # bounded by the sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entropy, length = sent.value.entropies(batch.column(1).to_pylist())
            at = [sent.value.languages.index(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(entropy[np.arange(len(at)), at]), pa.array(length)], ["name", "entropy", "length"])

    rows = texts.select(names.alias("name"), "text").where(F.col("name").isin(found.languages))
    scores = rows.mapInArrow(score, "name string, entropy double, length bigint").toPandas()
    return scores[scores["length"] > 0]


def _limit(entropy: np.ndarray) -> tuple[float, float]:
    middle = float(np.median(entropy))
    return middle, max(1.4826 * float(np.median(np.abs(entropy - middle))), LEAST_DEVIATION)


def train(docs: DataFrame, most: int = SAMPLE_DOCS) -> Identifier:
    """An identifier from documents' text and non-null lang outside fold 0.

    A language is calibrated on the sample documents kept from fitting. Where they are fewer than
    LEAST_CALIBRATION, its whole sample is, each CALIBRATE-th part under a model of the others. A
    language with a single text takes the median limit of the others; only if it is the only one that
    was learned, nothing is rejected.
    """
    drawn = staged(sample(docs, most), "language-sample")
    table = counted(drawn.where("part <> 0"), "lang").toPandas()
    languages = sorted(table["lang"].unique())
    alphabet = max(1, int((table["k"] == 1).sum())) + 1
    models = [_fitted(table[table["lang"] == lang], alphabet) for lang in languages]
    found = Identifier(languages, models, [(float("inf"), 0.0)] * len(models))
    if not languages:
        return found
    held = _entropies(drawn.where(F.col("part") == 0), F.col("lang"), found)
    own = {lang: held[held["name"] == lang]["entropy"].to_numpy() for lang in languages}
    limits = {lang: _limit(x) for lang, x in own.items() if len(x) >= LEAST_CALIBRATION}
    small = [lang for lang in languages if lang not in limits]
    if small:
        few = drawn.where(F.col("lang").isin(small))
        parts = counted(few, "lang", "part").toPandas()
        folds = {f"{part}/{lang}": parts[(parts["lang"] == lang) & (parts["part"] != part)] for lang, part in parts[["lang", "part"]].drop_duplicates().itertuples(index=False)}
        folds = {name: rows for name, rows in folds.items() if len(rows)}
        crossed = Identifier(list(folds), [_fitted(rows, alphabet) for rows in folds.values()], [(float("inf"), 0.0)] * len(folds), slots=1 << 12)
        scores = _entropies(few, F.concat(F.col("part").cast("string"), F.lit("/"), F.col("lang")), crossed) if folds else held[:0]
        for lang in small:
            mine = scores[scores["name"].str.partition("/")[2] == lang]["entropy"].to_numpy() if len(scores) else np.zeros(0)
            if len(mine):
                limits[lang] = _limit(mine)
    for i, lang in enumerate(languages):
        if lang in limits:
            found.limits[i] = limits[lang]
        elif limits:
            found.limits[i] = tuple(float(x) for x in np.median(list(limits.values()), axis=0))
    return found


def identify(docs: DataFrame, model: Identifier) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted: a row for each row of docs.

    Only text is read for a prediction. Null text or text without a letter is `und` with score 0,
    not accepted; the same holds for all texts if no row was labelled. Null ids are held out.
    Repeated rows get equal predictions; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lang, score, kept = zip(*sent.value.predict(part.column(2).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(kept, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")


def keep_identified(docs: DataFrame, model: Identifier) -> DataFrame:
    """docs, all columns, without the documents whose language is rejected: those without a letter
    and those whose text no learned language explains."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [c.lower() for c in names].index("text")
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                good = [x[2] for x in sent.value.predict(part.column(at).to_pylist())]
                yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
