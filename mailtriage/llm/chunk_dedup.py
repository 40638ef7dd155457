"""Substring deduplication by content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes are cut where the gear hash of the last WINDOW bytes is the least one within
REACH bytes on either side, and MOST bytes after the last cut at the latest. Whether a place is a
cut depends on the bytes around it alone, so copies of a passage fall into step REACH + WINDOW
bytes after its start, whatever surrounds them. Chunks are deduplicated by a 128-bit digest: the
first one in the order of (doc_id, text hash, place) stays, later ones go. Chunks are longer than
REACH bytes, unless the document is shorter: marks lie further apart, and forced cuts too.

Chunks travel as (digest, document key, place, length), never with text. Counts per digest are
partially aggregated before the shuffle, and the join back is a plain equi-join that adaptive
execution may split, so a passage that a third of all documents share is no single task's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .cutting import keyed, remove_spans
from .suffix_dedup import sliding_min

REACH, MOST = 22, 512
WINDOW = 8
_GEAR = np.random.Generator(np.random.PCG64(7041776)).integers(0, 2**32, 256, dtype=np.uint32)


def gear(data: np.ndarray, window: int = 32) -> np.ndarray:
    """The gear hash (h = 2h + G[byte], 32 bits) after each byte, of the last bytes (a power of
    two of them); with 32 it is the endless hash, which forgets the others by itself."""
    h = _GEAR[data]
    step = 1
    while step < window:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def cuts(data: bytes, reach: int = REACH, most: int = MOST) -> list[int]:
    """The ends of the chunks of data."""
    n = len(data)
    if not n:
        return []
    marks = np.zeros(0, np.int64)
    if n > 2 * reach:
        h = gear(np.frombuffer(data, np.uint8), WINDOW)
        least = sliding_min(h, reach)
        own = h[reach : n - reach]
        # Of equal hashes the first counts; one that has its equal before it is no cut.
        marks = np.flatnonzero((own < least[: n - 2 * reach]) & (own <= least[reach + 1 :])) + reach + 1
    ends, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > most:  # a forced cut leaves more than `reach` bytes
            last += most if m - last > most + reach else (m - last) // 2
            ends.append(last)
        ends.append(m)
        last = m
    return ends


def chunks(docs: DataFrame) -> DataFrame:
    """k_id, k_text, place, size, d1, d2: a row for each chunk; (d1, d2) is its digest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, places, sizes, digests = [], [], [], [], bytearray()
            for k_id, k_text, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                last = 0
                for end in cuts(data):
                    ids.append(k_id)
                    hashes.append(k_text)
                    places.append(last)
                    sizes.append(end - last)
                    digests += hashlib.blake2b(data[last:end], digest_size=16).digest()
                    last = end
                if len(ids) > 100_000:
                    yield _rows(ids, hashes, places, sizes, digests)
                    ids, hashes, places, sizes, digests = [], [], [], [], bytearray()
            if ids:
                yield _rows(ids, hashes, places, sizes, digests)

    return keyed(docs).select("k_id", "k_text", "data").mapInArrow(cut, "k_id bigint, k_text bigint, place int, size int, d1 bigint, d2 bigint")


def _rows(ids, hashes, places, sizes, digests) -> pa.RecordBatch:
    d = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
    columns = [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(places, pa.int32()), pa.array(sizes, pa.int32()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())]
    return pa.RecordBatch.from_arrays(columns, ["k_id", "k_text", "place", "size", "d1", "d2"])


def repeats(docs: DataFrame) -> DataFrame:
    """k_id, k_text, spans: for each document that loses bytes, its removed (start, end) in order."""
    cut = staged(chunks(docs), "chunks")
    first = F.min(F.struct("k_id", "k_text", "place")).alias("first")
    shared = cut.groupBy("d1", "d2").agg(F.count("*").alias("n"), first).where("n > 1").select("d1", "d2", "first")
    found = cut.join(shared.hint("merge"), ["d1", "d2"]).where(F.struct("k_id", "k_text", "place") != F.col("first"))
    later = found.select("k_id", "k_text", "place", "size").distinct()
    order = Window.partitionBy("k_id", "k_text").orderBy("place")
    gap = F.coalesce(F.lag(F.col("place") + F.col("size")).over(order) != F.col("place"), F.lit(True))
    runs = later.withColumn("gap", gap.cast("int")).withColumn("run", F.sum("gap").over(order))
    runs = runs.groupBy("k_id", "k_text", "run").agg(F.min("place").alias("start"), F.max(F.col("place") + F.col("size")).alias("end"))
    return runs.groupBy("k_id", "k_text").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def deduplicate(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and, unless with_text is false, kept:
    a row for each row of docs.

    kept is what remains (bytes, as a cut may fall inside a character), spans the removed byte
    ranges. Null text is empty. Rows with equal doc_id and text are one document to the order of
    copies: they lose the same spans, so only copies in other documents or places count against
    them. Other columns are ignored; an empty table gives no rows.
    """
    return remove_spans(docs, staged(repeats(docs), "chunk-repeats"), with_text)
