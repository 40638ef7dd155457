"""Documents by key, and the removal of byte spans from them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

SPANS = "array<struct<start:int,end:int>>"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k_id, k_text, data: the key (k_id, k_text) is that of the id and the text, so rows
    that repeat share it and rows that share an id alone don't; whole-number ids keep their order.
    data is the text's bytes."""
    number = F.coalesce(F.col("doc_id").try_cast("long"), F.xxhash64("doc_id"))
    return docs.select("doc_id", number.alias("k_id"), F.xxhash64("doc_id", text_of()).alias("k_text"), text_of().cast("binary").alias("data"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans, in order."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def remove_spans(docs: DataFrame, spans: DataFrame, with_text: bool = True) -> DataFrame:
    """Each row of docs without the spans (k_id, k_text, spans) of its document; see the columns below."""
    rows = keyed(docs)
    own = spans.withColumnsRenamed({"k_id": "s_id", "k_text": "s_text"})
    rows = rows.join(own.hint("merge"), (rows["k_id"] == own["s_id"]) & (rows["k_text"] == own["s_text"]), "left").select("doc_id", "data", F.col("spans").cast(SPANS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept"] * with_text]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            sizes, gone, counts, digests, runs, texts = [], [], [], [], [], []
            for data, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = data.as_buffer().to_pybytes()
                own, pieces, at = merged(found or []), [], 0
                for start, end in own:
                    pieces.append(text[at:start])
                    at = end
                kept = b"".join([*pieces, text[at:]]) if own else text
                sizes.append(len(text))
                gone.append(len(text) - len(kept))
                counts.append(len(own))
                digests.append(hashlib.sha256(kept).hexdigest())
                runs.append([{"start": a, "end": b} for a, b in own])
                if with_text:
                    texts.append(kept)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(runs, span)]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(texts, pa.binary())] * with_text], names)

    return rows.mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans {SPANS}" + ", kept binary" * with_text)
