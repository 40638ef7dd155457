"""A quality classifier over supervised subword embeddings.

A text's features are its words, its character n-grams of 3 to 5 bytes (none over a blank inside, so the
first and last of a word know that they are) and a mark for each word that repeats the one before it.
Features are hashed into BUCKETS rows of an embedding table; a text is the average of its features' rows,
and a softmax over the average gives the probability of each label. Table and softmax are trained together
by stochastic gradient descent in numpy, one text a step. Letter case and punctuation count.

Fitting takes a bounded sample: of each label SAMPLE_DOCS labelled texts at most, whole texts, of
SAMPLE_BYTES together (ones over a sixteenth of that are not drawn), so one task trains the model whatever
the number of labels. Prediction reads every whole text in place, without a shuffle. The softmax of two
labels sees an average through one direction only, so the table's projection on it is all that scoring
needs: one number for each bucket (1 MB), sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_of
from .language_id import fold
from .words import mixed, placed_words

BITS = 17
BUCKETS = 1 << BITS
DIMENSIONS = 8
SIZES = (3, 4, 5)
SAMPLE_DOCS, SAMPLE_BYTES = 1000, 4 << 20
RATE, ROUNDS, LEAST_STEPS = 5.0, 5, 6000
THRESHOLD = 0.3
#: Weights are whole multiples of 1 / UNIT.
UNIT = 1 << 24
#: Bytes of text that are read at a time. A word without white space over that length counts as several.
PIECE = 1 << 20
_BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_TO_BLANK = bytes(32 if b in _BLANKS else b for b in range(256))
_REPEAT = 7


def _bucket(h: np.ndarray) -> np.ndarray:
    return (mixed(h) >> np.uint64(64 - BITS)).astype(np.int32)


def features(held: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each feature, where each text's begin) for each kind of feature of some texts."""
    first = np.cumsum([0, *(len(x) + 1 for x in held[:-1])])
    text = b" " + b" ".join(held) + b" "  # first: the blank before each text
    b = np.frombuffer(text.translate(_TO_BLANK), np.uint8)
    blanks = np.cumsum(b == 32, dtype=np.int32)
    x, h = b.astype(np.uint64), b.astype(np.uint64)
    with np.errstate(over="ignore"):
        for size in range(2, SIZES[-1] + 1):
            h = (h[:-1] << np.uint64(8)) | x[size - 1 :]
            if size in SIZES:
                at = np.flatnonzero(blanks[size - 2 : size - 2 + len(h)] == blanks[: len(h)])
                yield _bucket(h[at] + np.uint64(size << 56)), np.searchsorted(at, first)
        at, words = placed_words(b)
        begins = np.searchsorted(at, first)
        yield _bucket(words), begins
        same = np.zeros(len(words), bool)
        same[1:] = words[1:] == words[:-1]
        same[begins[begins < len(words)]] = False  # the first word of a text repeats nothing
        again = at[same]
        yield np.full(len(again), _REPEAT, np.int32), np.searchsorted(again, first)


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of PIECE bytes at most, cut at white space if there is any."""
    begin = 0
    while len(text) - begin > PIECE:
        end = max(text.rfind(bytes([c]), begin + 1, begin + PIECE) for c in _BLANKS)
        end = end if end > begin else begin + PIECE
        yield text[begin:end]
        begin = end
    yield text[begin:]


@dataclass
class Model:
    """What each bucket adds to the log odds of label 1, in units of 1 / UNIT, and the log odds without
    features."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 of each text. Sums are of whole numbers, so a text's score does not
        depend on the texts beside it."""
        sums, counts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        held, owners, size = [], [], 0
        for i, text in enumerate(texts):
            for piece in pieces(text.encode()):
                held.append(piece)
                owners.append(i)
                size += len(piece) + 1
                if size >= PIECE:
                    self._add(sums, counts, held, owners)
                    held, owners, size = [], [], 0
        if held:
            self._add(sums, counts, held, owners)
        odds = sums / UNIT / np.maximum(counts, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def _add(self, sums: np.ndarray, counts: np.ndarray, held: list[bytes], owners: list[int]) -> None:
        for bucket, begins in features(held):
            before = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.weights[bucket])))
            edges = np.append(begins, len(bucket))
            np.add.at(sums, owners, np.diff(before[edges]))
            np.add.at(counts, owners, np.diff(edges))


def fit(texts: list[str], labels: list[int]) -> Model:
    """Trains on the given texts, in an order drawn from a fixed seed."""
    rng = np.random.Generator(np.random.PCG64(11))
    rows = []
    for text in texts:
        found = np.concatenate([bucket for piece in pieces(text.encode()) for bucket, _ in features([piece])])
        bucket, times = np.unique(found, return_counts=True)
        rows.append((bucket, (times / max(1, len(found))).astype(np.float32)))
    table = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    soft, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    steps = max(ROUNDS * len(rows), LEAST_STEPS) if rows else 0
    order: list[int] = []
    for step in range(steps):
        if not order:
            order = rng.permutation(len(rows)).tolist()
        i = order.pop()
        rate = np.float32(RATE * (1 - step / steps))
        bucket, share = rows[i]
        mine = table[bucket]
        average = share @ mine
        odds = soft @ average + bias
        wrong = np.exp(odds - odds.max())
        wrong /= wrong.sum()
        wrong[labels[i]] -= 1
        back = soft.T @ wrong
        soft -= rate * np.outer(wrong, average)
        bias -= rate / 10 * wrong
        table[bucket] = mine - rate * np.outer(share, back)
    weights = table @ (soft[1] - soft[0])
    return Model(np.round(weights.astype(np.float64) * UNIT).astype(np.int64), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE_DOCS) -> DataFrame:
    """(label, draw, text) of at most `most` documents of each label outside fold 0, drawn by a hash of
    their id.

    Ids are drawn from the labels first, twice as many as wanted, so the documents meet a list of a few
    thousand ids. Documents that share an id give one text, the least.
    """
    rows = labels.where(F.col(label).isin(0, 1) & (fold(F.col("doc_id")) != 0)).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    rows = rows.withColumn("draw", F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")))
    counts = staged(rows.groupBy("label").agg(F.count("*").alias("n")), "quality-labels")
    share = (1 << 20) * (2.0 * most + 32) / F.col("n")
    drawn = rows.join(counts, "label").where(F.pmod("draw", F.lit(1 << 20)) <= share).select("doc_id", "label", "draw")
    texts = docs.select("doc_id", text_of().alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES // 16)
    # Twice `most` ids a label: a few hundred KB.
    found = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label", "draw").agg(F.min("text").alias("text"))
    order = Window.partitionBy("label").orderBy("draw", "doc_id")
    ranked = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    ranked = ranked.withColumn("bytes", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where(F.col("bytes") <= SAMPLE_BYTES).select("label", "draw", "text")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE_DOCS) -> Model:
    """A model of a 0/1 column of labels (doc_id, ...). Other values and nulls teach nothing, nor do ids in
    fold 0 or without a document; an id with both labels teaches both. Without rows all scores are 0.5."""
    drawn = staged(sample(docs, labels, label, most), "quality-sample")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[1], r[0], r[2]))
        model = fit([r[2] for r in rows], [r[0] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], ["weights", "bias"])

    one = staged(drawn.coalesce(1).mapInArrow(learn, "weights binary, bias double"), "quality-model").first()
    return Model(np.frombuffer(one.weights, np.int64), one.bias) if one else fit([], [])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs.

    Only the text is read for a score: the probability of label 1. Null text, empty text and text of white
    space alone have no features and get the probability of the softmax's constants. Null ids are held
    out. Equal texts get equal scores. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = sent.value.scores(part.column(2).to_pylist())
                columns = [part.column(0), part.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
