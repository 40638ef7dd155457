"""Audit of how the sources of a language differ in their words.

Terms are runs of letters (any code point from U+0080 counts as one), A-Z lower-cased. A language keeps
the terms that LEAST_DOCS of its documents hold. Each (language, source) group and each language gives
each kept term a share of SCALE, smoothed by one; groups are compared with the other sources of their
language over all kept terms, and with the language term by term. All arithmetic is on whole numbers.

Kept terms are encoded as whole numbers: the table of counts is dealt by ranges of (language, term) and
sorted, so chunks of at most CHUNK_TERMS terms in UTF-8 order are cut from it, each a row of its own with
the sorted terms and the counts as (source, term, n). Inside a chunk searchsorted gives ids in term order,
and one bincount turns the counts into a dense vector for each source of the language; comparisons of
chunks add up. Nothing is broadcast: a chunk meets its language's list of sources in a join.

Texts are read once and never shuffled; each task counts in a table of at most HELD terms at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
#: Terms that a task counts before it hands the counts on.
HELD = 300_000
#: Terms and counts of a chunk at most.
CHUNK_TERMS, CHUNK_COUNTS = 4096, 1 << 17
#: Cells of one comparison of a source with several others.
CELLS = 1 << 19
#: Largest count for which SCALE times it stays within 64 bits.
_SAFE = 2**63 // SCALE - 2
#: Lower-cases A-Z and makes a blank of every other byte below 128 that is no letter.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it), by task; each task also gives
    every group it meets a row without term. Null text, lang or source is ''."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, docs_of) in held.items():
                terms = list(times)
                columns = [pa.array(terms, pa.binary()).cast(pa.string()), pa.array(times.values(), pa.int64()), pa.array(map(docs_of.__getitem__, terms), pa.int64())]
                group = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*group, *columns], ["lang", "source", "term", "n", "docs"])
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(([lang], [source], [None], [0], [0]), [pa.string()] * 3 + [pa.int64()] * 2, strict=True)], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                times, docs_of = held.setdefault((lang, source), (Counter(), Counter()))
                words = text.encode().translate(_LETTERS).split()
                size -= len(times)
                times.update(words)
                docs_of.update(set(words))
                size += len(times) + 1
                if size > HELD:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def kept_terms(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, first of the terms that `least` documents of the language hold; first is
    true in one row of each (lang, term). A row without term stands for each group."""
    # By group first: a frequent term's counts from all tasks add up before its language meets.
    each = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    each = each.withColumn("held", F.sum("docs").over(term)).withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
    return each.where(F.col("term").isNull() | (F.col("held") >= least)).select("lang", "source", "term", "n", "first")


def chunked(kept: DataFrame) -> DataFrame:
    """lang, terms, sources, at, n: chunks of kept terms in UTF-8 order, with the terms' counts as
    parallel arrays (at is the term of a count). A row for each chunk."""
    # Terms are dealt and sorted by language and term; one term's counts stay together.
    rows = kept.where(F.col("term").isNotNull()).select("lang", "term", "source", "n")
    rows = rows.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, terms, sources, of, n = None, [], [], [], []

        def chunk() -> pa.RecordBatch:
            columns = [pa.array([lang]), *(pa.array([x], pa.list_(k)) for x, k in ((terms, pa.string()), (sources, pa.string()), (of, pa.string()), (n, pa.int64())))]
            return pa.RecordBatch.from_arrays(columns, ["lang", "terms", "sources", "at", "n"])

        for batch in batches:
            for own, term, source, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = own != lang or not terms or term != terms[-1]
                if terms and (own != lang or new and (len(terms) >= CHUNK_TERMS or len(n) >= CHUNK_COUNTS)):
                    yield chunk()
                    terms, sources, of, n = [], [], [], []
                lang = own
                if new:
                    terms.append(term)
                sources.append(source)
                of.append(term)
                n.append(count)
        if terms:
            yield chunk()

    return rows.mapInArrow(cut, "lang string, terms array<string>, sources array<string>, at array<string>, n array<bigint>")


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exactly."""
    if counts.size and int(counts.max()) > _SAFE:
        return np.array([1 + SCALE * (int(c) + 1) // (total + kept) for c in counts.ravel()], np.int64).reshape(counts.shape)
    return 1 + SCALE * (counts + 1) // (total + kept)


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p-q)^2 / q); shares are at most SCALE + 1, so squares stay within 64 bits."""
    d = p - q
    return d * d // q


def _compared(terms: np.ndarray, sources: list[str], at: np.ndarray, n: np.ndarray, groups: list[tuple[str, int]], kept: int) -> Iterator[tuple]:
    """(source, part, item, value) of one chunk. groups: all sources of the language with their totals,
    in order."""
    places = {s: i for i, (s, _) in enumerate(groups)}
    size = len(terms)
    cell = np.fromiter((places[s] for s in sources), np.int64, len(sources)) * size + np.searchsorted(terms, at)
    # Each cell gets one count, below 2**53, so the sums are exact.
    dense = np.bincount(cell, n, len(groups) * size).astype(np.int64).reshape(len(groups), size)
    p = np.stack([shares(dense[i], total, kept) for i, (_, total) in enumerate(groups)]) if size else np.ones((len(groups), 0), np.int64)
    q = shares(dense.sum(axis=0), sum(t for _, t in groups), kept) if size else np.ones(0, np.int64)
    step = max(1, CELLS // max(1, size))
    for i, (source, _) in enumerate(groups):
        for begin in range(0, len(groups), step):
            sums = distances(p[i], p[begin : begin + step]).sum(axis=1)
            for j, value in enumerate(sums.tolist(), begin):
                if j != i:
                    yield source, "pair", groups[j][0], value
        over = np.flatnonzero((dense[i] > 0) & (p[i] > q))
        values = distances(p[i][over], q[over])
        # Ids are in UTF-8 order: a stable sort leaves equal values in the order of their terms.
        for k in np.argsort(-values, kind="stable")[:TOP_TERMS].tolist():
            yield source, "term", terms[over[k]], int(values[k])


def compare(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: each other source of the language with the
    summed distance over all kept terms; part `term`: up to TOP_TERMS terms that the group uses and
    prefers to its language, by distance. Ranks start at 1 for each group and part, by value from the
    top, then by item in UTF-8 order.

    Null text, lang and source are ''. Repeated rows count as documents of their own. A language
    without kept terms has pairs of value 0 and no terms; one with a single source has no pairs. Texts
    may be of any length. Other columns are ignored. An empty table gives no rows.
    """
    kept = staged(kept_terms(term_counts(docs), least), "divergence-terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("term").isNotNull() & F.col("first"), 1).otherwise(0)).alias("kept"))
    languages = totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("groups"), F.sum("kept").alias("kept"))
    rows = chunked(kept).join(languages, "lang", "right").select("lang", "terms", "sources", "at", "n", F.col("groups.source").alias("names"), F.col("groups.total").alias("totals"), "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, terms, sources, at, n, names, totals, vocabulary = (c[i].as_py() for c in batch.columns)
                # Compared as bytes, as Spark compares strings.
                as_bytes = [np.array([t.encode() for t in x or ()], object) for x in (terms, at)]
                found = list(_compared(as_bytes[0], sources or [], as_bytes[1], np.array(n or (), np.int64), list(zip(names, totals, strict=True)), vocabulary))
                if found:
                    source, part, item, value = zip(*found, strict=True)
                    item = [x.decode() if isinstance(x, bytes) else x for x in item]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), *map(pa.array, (source, part, item, value))], ["lang", "source", "part", "item", "value"])

    found = staged(rows.mapInArrow(run, "lang string, source string, part string, item string, value long"), "divergence-parts")

    def rank(rows: DataFrame) -> Column:
        return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).cast("int").alias("rank")

    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = found.where("part = 'term'")
    return pairs.select("*", rank(pairs)).unionByName(terms.select("*", rank(terms)).where(F.col("rank") <= TOP_TERMS))
