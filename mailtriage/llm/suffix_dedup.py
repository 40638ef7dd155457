"""Exact removal of repeated windows: a depth-limited radix sort of suffixes.

Suffixes need order only through LENGTH bytes; two windows of that length are equal if and only if
their suffixes fall in one group after that depth. Ordering all suffixes would deal out a row for
each byte, so the passes go from coarse to fine, most significant digit first, and each keeps only
groups of two or more:

1. First digit: the window's anchor, the GRAM bytes of least hash inside it (leftmost of equals).
   Equal windows have equal anchors at equal offsets. Neighbouring windows share an anchor, so
   there is one row per run of windows, about one for each 85 bytes. Runs whose gram occurs once
   hold no repeated window.
2. Second digit: all bytes that the run's windows cover. Runs that agree in them are repeated whole.
3. Third digit: for grams whose runs differ, one run of each kind is cut at every STEP-th offset
   from its anchor. The bytes that all windows of a piece share are the digit; pieces whose digit
   occurs once go, and pieces that agree in all bytes they cover are repeated whole.
4. Last digit, through the full depth: of the pieces that share a digit and still differ, one of
   each kind has its windows dealt out by their whole content. These are the very edges of
   repeated passages.

Digits travel as hashes (64 bits for the first, a filter only; 128-bit digests of the bytes for the
others). Counts are partially aggregated before each shuffle. Joins
are merge joins at every size, so that a small table runs the plan of a large one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged
from .cutting import keyed, remove_spans
from .words import _LETTER, _grown, mixed

LENGTH, GRAM, STEP = 200, 32, 16


def gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """A hash of each `gram` bytes in a row."""
    b = np.frombuffer(data, np.uint8)
    up, down = _grown(len(b) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[b] * up[: len(b)], dtype=np.uint64)))
    return mixed((sums[gram:] - sums[:-gram]) * down[: len(b) - gram + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, by running minima inside blocks of that width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor's gram hash, anchor) of each run of windows that share an anchor."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    h = gram_hashes(data, gram)
    high = np.uint64(32)
    anchor = sliding_min((h >> high << high) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & np.uint64(0xFFFFFFFF)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.concatenate((first[1:] - 1, [len(anchor) - 1]))
    at = anchor[first].astype(np.int64)
    return first, last, h[at], at


def _digests(pieces: Iterator[bytes]) -> tuple[pa.Array, pa.Array]:
    d = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in pieces), np.int64).reshape(-1, 2)
    return pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1]))


def first_digits(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """g, d1, d2, k_id, k_text, first, last, anchor: the runs of all documents with their first two
    digits, the gram and the digest of the bytes they cover. One scan takes both."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k_id, k_text, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                text = data.as_buffer().to_pybytes()
                first, last, g, anchor = runs(text, length, gram)
                if len(g):
                    n = len(g)
                    d1, d2 = _digests(text[a : b + length] for a, b in zip(first.tolist(), last.tolist(), strict=True))
                    columns = [pa.array(g.view(np.int64)), d1, d2, pa.repeat(k_id, n), pa.repeat(k_text, n), *(pa.array(x.astype(np.int32)) for x in (first, last, anchor))]
                    yield pa.RecordBatch.from_arrays(columns, ["g", "d1", "d2", "k_id", "k_text", "first", "last", "anchor"])

    return keyed(docs).select("k_id", "k_text", "data").mapInArrow(scan, "g bigint, d1 bigint, d2 bigint, k_id bigint, k_text bigint, first int, last int, anchor int")


def _with_text(docs: DataFrame, wanted: DataFrame, *fields: str) -> DataFrame:
    """k_id, k_text, data, own: the documents of wanted, with their rows' fields as an array."""
    own = wanted.groupBy(F.col("k_id").alias("w_id"), F.col("k_text").alias("w_text")).agg(F.collect_list(F.struct(*fields)).alias("own"))
    rows = keyed(docs).select("k_id", "k_text", "data")
    return rows.join(own.hint("merge"), (rows["k_id"] == own["w_id"]) & (rows["k_text"] == own["w_text"])).select("k_id", "k_text", "data", "own")


def third_digit(docs: DataFrame, kinds: DataFrame, length: int, step: int) -> DataFrame:
    """c1, c2, d1, d2, k_id, k_text, first, last: the pieces of the runs (first, last, anchor), with the
    digests of the bytes that all their windows share and of all bytes they cover."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k_id, k_text, data, own in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                text, firsts, lasts, cores = data.as_buffer().to_pybytes(), [], [], []
                for r in own:
                    a = r["anchor"]
                    for j in range((a - r["last"]) // step, (a - r["first"]) // step + 1):
                        firsts.append(max(r["first"], a - step * j - step + 1))
                        lasts.append(min(r["last"], a - step * j))
                        cores.append(text[a - step * j : a - step * j - step + 1 + length])
                n = len(firsts)
                whole = _digests(text[x : y + length] for x, y in zip(firsts, lasts, strict=True))
                columns = [*_digests(iter(cores)), *whole, pa.repeat(k_id, n), pa.repeat(k_text, n), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["c1", "c2", "d1", "d2", "k_id", "k_text", "first", "last"])

    return _with_text(docs, kinds, "first", "last", "anchor").mapInArrow(scan, "c1 bigint, c2 bigint, d1 bigint, d2 bigint, k_id bigint, k_text bigint, first int, last int")


def last_digit(docs: DataFrame, pieces: DataFrame, length: int) -> DataFrame:
    """d1, d2, k_id, k_text, at: the windows of the pieces (first, last), each with its digest."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k_id, k_text, data, own in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                text = data.as_buffer().to_pybytes()
                at = np.concatenate([np.arange(r["first"], r["last"] + 1, dtype=np.int32) for r in own])
                d1, d2 = _digests(text[a : a + length] for a in at.tolist())
                yield pa.RecordBatch.from_arrays([d1, d2, pa.repeat(k_id, len(at)), pa.repeat(k_text, len(at)), pa.array(at)], ["d1", "d2", "k_id", "k_text", "at"])

    return _with_text(docs, pieces, "first", "last").mapInArrow(scan, "d1 bigint, d2 bigint, k_id bigint, k_text bigint, at int")


def _in_two_places(rows: DataFrame, *keys: str, at: str) -> DataFrame:
    """The keys that rows have at two different places (repeated rows give one place twice)."""
    place = F.struct("k_id", "k_text", at)
    return rows.groupBy(*keys).agg(F.min(place).alias("one"), F.max(place).alias("other")).where("one <> other").select(*keys)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP) -> DataFrame:
    """k_id, k_text, spans: the byte ranges of each document covered by repeated windows; ranges may overlap."""
    every = staged(first_digits(docs, length, gram), "runs")
    grams = staged(every.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "grams")
    kept = staged(every.join(grams.hint("shuffle_hash"), "g", "left_semi"), "kept")
    discard(every, grams)

    one = F.min(F.struct("k_id", "k_text", "first", "last", "anchor")).alias("one")
    kinds = staged(kept.groupBy("g", "d1", "d2").agg(F.count("*").alias("n"), one), "kinds")
    whole = kept.join(kinds.where("n > 1").select("d1", "d2").hint("merge"), ["d1", "d2"], "left_semi").select("k_id", "k_text", "first", "last")

    several = kinds.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1").select("g")
    pieces = staged(third_digit(docs, kinds.join(several.hint("merge"), "g", "left_semi").select("one.*"), length, step), "pieces")
    alive = staged(pieces.join(_in_two_places(pieces, "c1", "c2", at="first").hint("merge"), ["c1", "c2"], "left_semi"), "alive")
    same = alive.join(_in_two_places(alive, "d1", "d2", at="first").hint("merge"), ["d1", "d2"], "left_semi").select("k_id", "k_text", "first", "last")

    parts = staged(alive.groupBy("c1", "c2", "d1", "d2").agg(F.min(F.struct("k_id", "k_text", "first", "last")).alias("one")), "parts")
    several = parts.groupBy("c1", "c2").agg(F.count("*").alias("kinds")).where("kinds > 1").select("c1", "c2")
    windows = staged(last_digit(docs, parts.join(several.hint("merge"), ["c1", "c2"], "left_semi").select("one.*"), length), "windows")
    single = windows.join(_in_two_places(windows, "d1", "d2", at="at").hint("merge"), ["d1", "d2"], "left_semi").select("k_id", "k_text", F.col("at").alias("first"), F.col("at").alias("last"))

    spans = F.collect_list(F.struct(F.col("first").alias("start"), (F.col("last") + length).alias("end"))).alias("spans")
    return whole.unionByName(same).unionByName(single).groupBy("k_id", "k_text").agg(spans)


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and, unless with_text is false, kept:
    a row for each row of docs.

    Every byte covered by a string of `length` bytes that also starts anywhere else goes, in the
    same document too, overlaps counted; strings never cross documents and are judged on the input.
    Null text is empty; texts shorter than `length` lose nothing; a row that repeats another in id
    and text is a document of its own, so both lose all from `length` bytes on. Null ids are
    carried along; other columns are ignored; an empty table gives no rows.
    """
    return remove_spans(docs, staged(repeated_spans(docs, length, gram), "repeats"), with_text)
