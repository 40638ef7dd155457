"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

For every benchmark item of L words, each window of L words of each document gets a 64-bit SimHash
of its 5-word shingles, weighted by their counts. A fingerprint within `radius` of an item's agrees
with it up to radius // blocks bits in one of the blocks at least, so each block has a table of the
values that lie that near to an item's value: no fingerprint within the radius is missed. Those that
a table lets through are compared in full with the items of that length (64 bits each; lists of items
under each value would name a twentieth of them, at more than twenty times the cost of a comparison),
and the windows within the radius are verified by exact
weighted Jaccard similarity of their shingles (sum of minima of counts over sum of maxima).

The radius alone would lose some windows whose similarity is little above the least one. Those are
found by shared shingles: a window that is similar enough holds at least one of an item's rarest
shingles, if so many of them are taken that the others could not reach the similarity. Positions
with such a shingle lead to the windows around them, which are counted exactly. So no match is missed.

The benchmark is the stated query set: it meets all documents in blocks of bounded size, each sent
to the executors. Documents are not shuffled at all.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import sketch
from .common import staged, text_of
from .words import shingle_hashes, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BITS, RADIUS, BLOCKS = 64, 15, 4
#: The benchmark is sent in blocks of about so many bytes of text and items at most.
BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 4096
#: Positions that are scanned at a time, and the longest windows that are counted step by step.
STRETCH, STEPWISE = 8192, 256
#: Least bits of the table that sorts out positions without an item's rare shingle.
SIEVE = 20


def fingerprint(shingles: np.ndarray) -> np.uint64:
    """The SimHash of shingles: a bit is set if more of them have it than don't."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
    return np.packbits(2 * bits > len(shingles)).view(np.uint64)[0]


def window_fingerprints(shingles: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(m, SimHash of the window of m shingles that starts at each of the first positions), for m of
    lengths in order. The array ends with as many zeros as the longest window has shingles.

    All 64 bits are counted at once in vertical counters: planes[p] holds bit p of each position's
    64 counts, and a window grows by one shingle by adding one bit to them.
    """
    n = len(shingles) - lengths[-1]
    planes: list[np.ndarray] = []
    wanted = set(lengths)
    carry, spare, above, equal = (np.empty(n, np.uint64) for _ in range(4))
    for m in range(1, lengths[-1] + 1):
        if m.bit_length() > len(planes):
            planes.append(np.zeros(n, np.uint64))
        np.copyto(carry, shingles[m - 1 : m - 1 + n])
        for plane in planes:
            np.bitwise_and(plane, carry, out=spare)
            np.bitwise_xor(plane, carry, out=plane)
            carry, spare = spare, carry
        if m in wanted:
            least = m // 2 + 1
            above.fill(0)
            equal.fill(np.iinfo(np.uint64).max)
            for p in range(len(planes) - 1, -1, -1):
                if least >> p & 1:
                    np.bitwise_and(equal, planes[p], out=equal)
                else:
                    np.bitwise_and(equal, planes[p], out=spare)
                    np.bitwise_or(above, spare, out=above)
            yield m, above | equal


def long_fingerprints(shingles: np.ndarray, m: int) -> np.ndarray:
    """The same for one long window length, by running sums."""
    n = len(shingles) - m
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    return np.packbits(2 * (sums[m : m + n] - sums[:n]) > m, axis=1).view(np.uint64).ravel()


def neighbours(value: int, width: int, errors: int) -> list[int]:
    """All values of width bits that differ from value in so many bits at most."""
    found, edge = {value}, {value}
    for _ in range(errors):
        edge = {v ^ (1 << b) for v in edge for b in range(width)} - found
        found |= edge
    return list(found)


class Index:
    """The items of a benchmark block by window length: tables for each Hamming block, and what
    verifying needs. A length is a number of shingles; items of fewer words than a shingle are one
    shingle of all their words, and have the lengths -1, -2 and so on, their number of words."""

    def __init__(self, items: list[tuple[object, str]], radius: int = RADIUS, blocks: int = BLOCKS, shingle: int = SHINGLE, similarity: float = SIMILARITY):
        self.radius, self.blocks, self.similarity, self.shingle = radius, blocks, similarity, shingle
        self.width = BITS // blocks
        self.by_length: dict[int, tuple] = {}
        lengths: dict[int, list] = {}
        for item, text in items:
            words = word_hashes(text.encode())
            if len(words):
                own = shingle_hashes(words, shingle)
                lengths.setdefault(len(own) if len(words) >= shingle else -len(words), []).append((item, own))
        for length, own in sorted(lengths.items()):
            prints = np.array([fingerprint(s) for _, s in own], np.uint64)
            near = np.array(neighbours(0, self.width, radius // blocks), np.int64)
            tables = np.zeros((blocks, 1 << self.width), bool)
            for b in range(blocks):
                slots = (prints >> np.uint64(b * self.width)).astype(np.int64) & ((1 << self.width) - 1)
                tables[b, (slots[:, None] ^ near).ravel()] = True
            self.by_length[length] = ([i for i, _ in own], prints, [Counter(s.tolist()) for _, s in own], tables)
        self._index_rare()

    def _index_rare(self) -> None:
        """Lists each item under its rarest shingles, so many that any text or window without them
        has too little in common with the item."""
        bags = [(length, j, bag) for length, (_, _, bags, _) in self.by_length.items() if length > 0 for j, bag in enumerate(bags)]
        spread = Counter(s for _, _, bag in bags for s in bag)
        self.rare: dict[int, list[tuple[int, int]]] = {}
        self.shingles: dict[tuple[int, int], np.ndarray] = {}
        for length, j, bag in bags:
            self.shingles[length, j] = np.array(sorted(bag), np.uint64)
            spare = length - self._needed(length, self.similarity * length)
            for s in sorted(bag, key=lambda s: (spread[s], s)):
                if spare < 0:
                    break
                self.rare.setdefault(s, []).append((length, j))
                spare -= bag[s]
        size = 1 << max(SIEVE, len(self.rare).bit_length() + 4)
        self.mask, self.sieve = np.uint64(size - 1), np.zeros(size, bool)
        self.sieve[np.array(list(self.rare), np.uint64) & self.mask] = True

    def _needed(self, length: int, size: float) -> int:
        """The least number of shingles that size of them have in common with a similar item's length."""
        return math.ceil(self.similarity * (length + size) / (1 + self.similarity) - 1e-6)

    def sharing(self, own: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(length, item, first position) of the windows of a text's shingles that may match an item
        by the number of its shingles in them; at are positions that the sieve lets through. A text
        shorter than an item is one window."""
        near: dict[tuple[int, int], list[int]] = {}
        for i in at.tolist():
            for key in self.rare.get(int(own[i]), ()):
                near.setdefault(key, []).append(i)
        for (length, j), places in near.items():
            size = min(length, len(own))
            needed = self._needed(length, size)
            if needed > size:
                continue
            known, done = self.shingles[length, j], 0
            while places:  # stretches of windows that hold one of the positions
                lo = max(done, places[0] - size + 1)
                hi, k = min(places[0], len(own) - size), 1
                while k < len(places) and places[k] - size <= hi:
                    hi, k = min(places[k], len(own) - size), k + 1
                places, done = places[k:], hi + 1
                if lo <= hi:
                    part = own[lo : hi + size]
                    held = known.take(np.searchsorted(known, part), mode="clip") == part
                    total = np.concatenate(([0], np.cumsum(held)))
                    for i in np.flatnonzero(total[size:] - total[:-size] >= needed).tolist():
                        yield length, j, lo + i

    def near(self, prints: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
        """(window, item) with fingerprints within the radius."""
        _, items, _, tables = self.by_length[length]
        values = np.ascontiguousarray(prints.view(f"u{self.width // 8}").reshape(-1, self.blocks).T).astype(np.intp)
        passed = tables[0].take(values[0], mode="clip")
        for b in range(1, self.blocks):
            passed |= tables[b].take(values[b], mode="clip")
        at = np.flatnonzero(passed)
        if len(at):
            own = prints[at]
            for j, f in enumerate(items):
                for i in at[np.bitwise_count(own ^ f) <= self.radius]:
                    yield int(i), j

    def matches(self, texts: list[str]) -> list[tuple[int, object, float, int]]:
        """(text, item, similarity, first word of the window) of the best window of each item in
        each text. Texts are scanned end to end; windows that cross an end don't count."""
        words = [word_hashes(t.encode()) for t in texts]
        parts = [shingle_hashes(w, self.shingle) for w in words]
        ends = np.cumsum([len(p) for p in parts])
        best: dict[tuple[int, int, int], tuple[float, int]] = {}

        def verify(text: int, length: int, j: int, shingles: np.ndarray, first: int) -> None:
            bag, other = Counter(shingles.tolist()), self.by_length[length][2][j]
            same = sum(min(n, other.get(s, 0)) for s, n in bag.items())
            alike = same / (bag.total() + other.total() - same)
            if alike >= self.similarity and (alike, -first) > best.get((text, length, j), (0.0, 0)):
                best[text, length, j] = (alike, -first)

        positive = [n for n in self.by_length if n > 0]
        for t, p in enumerate(parts):  # texts shorter than an item are compared whole
            for m in positive if len(p) and positive and len(p) < positive[-1] else ():
                if len(p) < m and len(p) >= self.similarity * m:
                    for _, j in self.near(np.array([fingerprint(p)]), m):
                        verify(t, m, j, p, 0)
        for length in self.by_length:
            if length < 0:
                for t, w in enumerate(words):
                    few = shingle_hashes(w, -length) if len(w) >= -length else w[:0]
                    for i, j in self.near(few, length) if len(few) else ():
                        verify(t, length, j, few[i : i + 1], i)
        whole = np.concatenate([*parts, np.zeros(0, np.uint64)])
        passed = np.flatnonzero(self.sieve.take((whole & self.mask).astype(np.intp)))
        for t in np.unique(np.searchsorted(ends, passed, side="right")).tolist():
            start = int(ends[t]) - len(parts[t])
            for m, j, i in self.sharing(parts[t], passed[np.searchsorted(passed, start) : np.searchsorted(passed, ends[t])] - start):
                verify(t, m, j, parts[t][i : i + m], i)
        short, long = [m for m in positive if m <= STEPWISE], [m for m in positive if m > STEPWISE]

        def scan(base: int, m: int, prints: np.ndarray) -> None:
            for i, j in self.near(prints, m):
                at = base + i
                text = int(np.searchsorted(ends, at, side="right"))
                if at + m <= ends[text]:
                    verify(text, m, j, whole[at : at + m], at - int(ends[text] - len(parts[text])))

        for base in range(0, len(whole), STRETCH) if short else ():
            some = whole[base : base + STRETCH + short[-1]]
            missing = min(STRETCH, len(whole) - base) + short[-1] - len(some)
            for m, prints in window_fingerprints(np.concatenate((some, np.zeros(missing, np.uint64))), short):
                scan(base, m, prints)
        for m in long:
            for base in range(0, len(whole) - m + 1, STRETCH):
                some = whole[base : base + STRETCH + m]
                missing = min(STRETCH, len(whole) - base) + m - len(some)
                scan(base, m, long_fingerprints(np.concatenate((some, np.zeros(missing, np.uint64))), m))
        return [(t, self.by_length[n][0][j], s, -at) for (t, n, j), (s, at) in best.items()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word), a row for each document and item found in it.

    similarity is that of the best window, first_word the place of its first word (the first such
    window). Words are runs of anything but ASCII white space, A-Z lower-cased. Null and empty
    texts match nothing, on either side; an item of fewer than five words is one shingle; a
    document shorter than an item is compared as a whole. Repeated documents and items give
    repeated rows; null ids are carried along; other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", text_of().alias("text"), F.octet_length(text_of()).alias("size"))
    total = items.agg(F.sum("size"), F.count("*")).first()
    n = max(1, -(-(total[0] or 0) // block_bytes), -(-total[1] // block_items))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    doc_kind, item_kind = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    item_arrow = to_arrow_type(item_kind)
    rows = docs.select("doc_id", text_of().alias("text"))
    found = None
    for b in range(n):
        own = [(r["item_id"], r["text"]) for r in items.where(F.col("block") == b).select("item_id", "text").collect()]
        index = spark.sparkContext.broadcast(Index(own, radius, blocks, SHINGLE, similarity))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for part in range(0, whole.num_rows, 256):
                    batch = whole.slice(part, 256)
                    hits = index.value.matches(batch.column(1).to_pylist())
                    if not hits:
                        continue
                    at, ids, alike, first = zip(*hits, strict=True)
                    columns = [batch.column(0).take(pa.array(at)), pa.array(ids, item_arrow), pa.array(alike, pa.float64()), pa.array(first, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "similarity", "first_word"])

        part = rows.mapInArrow(scan, f"doc_id {doc_kind.simpleString()}, item_id {item_kind.simpleString()}, similarity double, first_word bigint")
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **kwargs) -> DataFrame:
    """docs, all columns, without the documents that hold a benchmark item. Rows of one doc_id go or
    stay together; rows whose doc_id is null stay only if no such row is contaminated. Only rows that a
    sketch of the contaminated ids lets pass are shuffled."""
    hit = staged(find_contamination(docs, benchmark, **kwargs).select("doc_id").distinct(), "contaminated")
    return sketch.without(docs, "doc_id", hit)
