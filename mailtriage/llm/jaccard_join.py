"""N-gram Jaccard join over whole documents, with count vectors and an R-tree.

A document is the set of its word shingles. An R-tree over count vectors of all documents does not
prune at this threshold: similar sets differ by about as much as chance moves strangers in each
coordinate. It does once points are taken from a common centre, so the join goes in three steps:

    cells     The sets of two linked documents differ in `most` shingles at most, so of most+1+spare
              ranges of the hash space spare+1 at least hold the same shingles in both. The content
              of each range is a cell. `most` follows from the size class; a document that may link
              with one of the next class has that class' cells too. Each document leaves `spare` cells
              out, first those without a shingle, then the most frequent ones (frequencies of the
              whole corpus). This cannot lose a pair: the order is the same for all, and of
              the cells that two documents share the last in that order is left out by neither.
              Nor has a document that shares no more than `spare` cells any left to meet in.
    centres   Every set is compared with the least set of each of its cells, its centres. The
              comparison gives links, and the set's flips: the shingles that it and the centre
              don't share. Components of these links close most groups.
    R-tree    Two sets of one centre differ in the flips that they don't share. Where a centre's
              sets are of different components still, their flips are hashed into DIMENSIONS groups;
              the counts are points of a packed R-tree. The coordinate minima of two points bound
              the flips that they share, those of two rectangles' upper corners bound them for all
              points inside. Pairs of different components that the bounds let through are
              verified on the flips themselves. A centre's sets are dealt out in blocks of bounded
              size, of which pairs meet; those of the centre's own component don't meet each other.

Linked documents share a cell that neither leaves out, hence a centre, so no link is lost. Only
components are asked for: a task returns links that join components, not all pairs. Equal sets are
one set throughout; ids of sets are 128-bit digests, then row numbers of the table that holds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import discard, staged
from .components import components
from .cutting import keyed
from .words import mixed, shingle_hashes, word_hashes

#: Coordinates of a point, points of a tree node, and the most sets and flips of a block.
DIMENSIONS, NODE, BLOCK_SETS, BLOCK_FLIPS = 256, 16, 2048, 1 << 20
#: Shuffles that the cells are dealt over, one after the other, so that the disk holds one share at a time.
TURNS = 2


class Threshold:
    """Similarity num/den: linked if den * intersection >= num * union."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.bounds = [1]
        self._plans: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}

    def needed(self, total):
        """The least intersection of linked sets whose sizes add up to total."""
        return -(-self.num * total // (self.num + self.den))

    def _bound(self, c: int) -> int:
        """The least size of class c. Sizes grow by a half or more, so linked sets are of one class or neighbours."""
        while len(self.bounds) <= c:
            last = self.bounds[-1]
            self.bounds.append(max(last + 1, 3 * last // 2, -(-last * self.den // self.num)))
        return self.bounds[c]

    def size_class(self, n: int) -> int:
        c = 0
        while self._bound(c + 1) <= n:
            c += 1
        return c

    def classes(self, n: int) -> list[int]:
        """The classes in which a set of n shingles has cells."""
        own = self.size_class(n)
        return [own, own + 1] if n * self.den >= self.num * self._bound(own + 1) else [own]

    def plan(self, c: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(spare, lower ends of the ranges, their salts) of class c; no ranges if linked sets are equal."""
        if c not in self._plans:
            most = 2 * (self._bound(c + 1) - 1) * (self.den - self.num) // (self.den + self.num)
            spare = most // 4 + 2
            m = most + 1 + spare if most else 0
            ends = [-(-j * 2**32 // m) << 32 for j in range(m)]
            self._plans[c] = (spare, np.array(ends, np.uint64), mixed(np.arange(m, dtype=np.uint64) + np.uint64(c << 32)))
        return self._plans[c]


def shingle_set(text: bytes, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text), k))


def cells_of(shingles: np.ndarray, limit: Threshold) -> list[tuple[int, np.ndarray]]:
    """(cells still to be left out, cells) of a sorted set in each of its classes: a hash of each range's
    content. Cells without a shingle are left out here, the least hashes first."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(shingles, dtype=np.uint64)))
    out = []
    for c in limit.classes(len(shingles)):
        spare, ends, salts = limit.plan(c)
        if not len(ends):
            out.append((0, ends))
            continue
        first = np.append(np.searchsorted(shingles, ends), len(shingles))
        at = sums[first]
        with np.errstate(over="ignore"):
            cells = mixed(at[1:] - at[:-1] + salts)
        few = np.flatnonzero(first[1:] - first[:-1] == 0)
        if len(few) > spare:
            few = few[np.argsort(cells[few], kind="stable")[:spare]]
        out.append((spare - len(few), np.delete(cells, few)))
    return out


def sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, rid, k_id, k_text, n, d1, d2, and of one or two size classes the spare numbers and cells:
    a row for each row of docs. rid is the row's number once the table is written; d1 and d2 (the
    set's digest) are null for an empty set or a null id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "rid", "k_id", "k_text", "n", "d1", "d2", "spare", "cells", "spare_next", "cells_next"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = Threshold(num, den)
        none = (0, np.zeros(0, np.uint64))
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                sizes, digests, held = [], [], ([], [])
                for doc_id, data in zip(batch.column(0), batch.column(4), strict=True):
                    s = shingle_set(data.as_buffer().to_pybytes(), k)
                    sizes.append(len(s))
                    known = len(s) and doc_id.is_valid
                    digests.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) if known else None)
                    own = cells_of(s, limit) if known else []
                    for side in (0, 1):
                        held[side].append(own[side] if side < len(own) else none)
                columns = [*batch.columns[:4], pa.array(sizes, pa.int64()), *(pa.array([None if d is None else int(d[i]) for d in digests], pa.int64()) for i in (0, 1))]
                for side in held:
                    ends = np.concatenate(([0], np.cumsum([len(c) for _, c in side]))).astype(np.int32)
                    columns += [pa.array([x for x, _ in side], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([c for _, c in side]).view(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = keyed(docs).select("doc_id", F.monotonically_increasing_id().alias("rid"), "k_id", "k_text", "data")
    return rows.mapInArrow(scan, f"doc_id {kind}, rid bigint, k_id bigint, k_text bigint, n bigint, d1 bigint, d2 bigint, spare int, cells array<bigint>, spare_next int, cells_next array<bigint>")


def centred(cells: DataFrame) -> DataFrame:
    """The distinct (z, x) of sets x and their centres z, from cells (sid, part, spare, cell): each set
    leaves out its `spare` most frequent cells of a part, and the least set of a cell is its centre.
    Cells that nobody shares, nearly all, go in TURNS shuffles, by hash, each of a share of them."""
    from pyspark.sql import Window

    parts = []
    for turn in range(TURNS):
        some = cells.where(F.pmod("cell", F.lit(TURNS)) == turn)
        counts = staged(some.groupBy("cell").agg(F.count("*").alias("m")).where("m > 1"), "counts")
        parts.append(staged(some.join(counts.hint("shuffle_hash"), "cell"), "shared"))
        discard(counts)
    place = F.row_number().over(Window.partitionBy("sid", "part").orderBy(F.desc("m"), "cell"))
    kept = staged(reduce(DataFrame.unionByName, parts).withColumn("place", place).where("place > spare").select("cell", "sid"), "kept")
    leads = kept.groupBy("cell").agg(F.min("sid").alias("z"), F.max("sid").alias("last")).where("z <> last").select("cell", "z")
    leads = staged(leads, "leads")
    pairs = staged(kept.join(leads.hint("shuffle_hash"), "cell").where("sid <> z").select("z", F.col("sid").alias("x")).distinct(), "pairs")
    discard(*parts, kept, leads)
    return pairs


def contents(docs: DataFrame, rows: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(sid, content): the shingles of every set of pairs. Of the texts, those that a sketch of the
    wanted keys lets pass are shuffled."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = [i for i, sid in enumerate(ids) if sid != (ids[i - 1] if i else last)]  # repeated rows stand together
            last = ids[-1] if ids else last
            found = [shingle_set(batch.column(1)[i].as_buffer().to_pybytes(), k).tobytes() for i in at]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], pa.int64()), pa.array(found, pa.binary())], ["sid", "content"])

    keys = rows.select("rid", F.col("k_id").alias("w_id"), F.col("k_text").alias("w_text"))
    wanted = pairs.select(F.col("z").alias("rid")).union(pairs.select("x")).distinct().join(keys.hint("merge"), "rid").withColumnRenamed("rid", "sid")
    # Rows that repeat another's id and text have its key.
    twice = staged(rows.groupBy("k_id", "k_text").agg(F.count("*").alias("m")).where("m > 1"), "repeated")
    wanted = wanted.join(twice, (F.col("w_id") == twice["k_id"]) & (F.col("w_text") == twice["k_text"]), "left").select("sid", "w_id", "w_text", F.col("m").isNotNull().alias("again"))
    wanted = staged(wanted, "wanted")
    texts = keyed(docs).select("k_id", "k_text", "data")
    texts = sketch.passing(texts, sketch.build(wanted, F.xxhash64("w_id", "w_text")), F.xxhash64("k_id", "k_text"))

    def found(some: DataFrame) -> DataFrame:
        met = texts.join(some.hint("merge"), (texts["k_id"] == some["w_id"]) & (texts["k_text"] == some["w_text"])).select("sid", "data")
        return met.mapInArrow(shingled, "sid bigint, content binary")

    out = found(wanted.where("not again"))
    if not twice.isEmpty():
        out = out.unionByName(found(wanted.where("again")).dropDuplicates(["sid"]))
    return staged(out, "contents")


def compared(pairs: DataFrame, own: DataFrame, num: int, den: int) -> DataFrame:
    """(z, x, n, linked, flips): n is x's size, flips are the shingles that only one of x and z has."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                sizes, linked, flips = [], [], []
                for x, z in zip(batch.column(2), batch.column(3), strict=True):
                    s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, z))
                    both = np.sort(np.concatenate((s, t)), kind="stable")
                    twice = both[1:] == both[:-1]
                    alone = np.append(~twice, True)
                    alone[1:] &= ~twice
                    same = int(twice.sum())
                    sizes.append(len(s))
                    linked.append(den * same >= num * (len(s) + len(t) - same))
                    flips.append(both[alone].tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(linked, pa.bool_()), pa.array(flips, pa.binary())], ["z", "x", "n", "linked", "flips"])

    left = own.select(F.col("sid").alias("x"), F.col("content").alias("mine"))
    right = own.select(F.col("sid").alias("z"), F.col("content").alias("other"))
    rows = pairs.join(left.hint("merge"), "x").join(right.hint("merge"), "z").select("z", "x", "mine", "other")
    return staged(rows.mapInArrow(compare, "z bigint, x bigint, n bigint, linked boolean, flips binary"), "compared")


def point(flips: np.ndarray) -> np.ndarray:
    return np.bincount((flips >> np.uint64(20)).astype(np.int64) % DIMENSIONS, minlength=DIMENSIONS)


def tree_pairs(points: np.ndarray, sizes: np.ndarray, side: np.ndarray, label: np.ndarray, limit: Threshold) -> Iterator[tuple[int, int, int]]:
    """(i, j, flips that they must share) of the pairs of one centre's sets that the tree's bounds let
    through. Pairs of one label, and of side 0 with each other unless all are 2, don't count.

    points are counts of flips, sizes those of the sets. Two sets of sizes p and q with a and b flips
    link if they share needed(p + q) - (p + q - a - b) / 2 flips.
    """
    if len(points):
        rare = (points > 0).sum(axis=0)
        own = np.where(points > 0, rare, len(points) + 1).argmin(axis=1)  # the rarest coordinate of each point
        order = np.lexsort((sizes, own))
        starts = np.arange(0, len(order), NODE)
        count = points.sum(axis=1).astype(np.int64)
        corner = np.maximum.reduceat(points[order], starts, axis=0)
        least, largest = np.minimum.reduceat(count[order], starts), np.maximum.reduceat(sizes[order], starts)
        slack = (limit.den - limit.num) / (2 * (limit.den + limit.num))
        for i, s in enumerate(starts.tolist()):
            a = order[s : s + NODE]
            low = (least[i] + least[i:]) / 2 - slack * (largest[i] + largest[i:])
            near = np.flatnonzero(np.minimum(corner[i], corner[i:]).sum(axis=1) >= low - 1e-6) + i
            b = np.concatenate([order[starts[j] : starts[j] + NODE] for j in near.tolist()]) if len(near) else order[:0]
            total = sizes[a][:, None] + sizes[b][None]
            share = limit.needed(total) - (total - count[a][:, None] - count[b][None]) // 2
            good = np.minimum(points[a][:, None], points[b][None]).sum(axis=2) >= share
            good &= (label[a][:, None] != label[b][None]) & ((side[a][:, None] != side[b][None]) | (side[a][:, None] == 2))
            place = np.concatenate([np.arange(starts[j], min(starts[j] + NODE, len(order))) for j in near.tolist()]) if len(near) else order[:0]
            good &= np.arange(s, s + len(a))[:, None] < place[None]
            x, y = np.nonzero(good)
            yield from zip(a[x].tolist(), b[y].tolist(), share[x, y].tolist(), strict=True)


def joins(flips: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, label: np.ndarray, limit: Threshold) -> list[tuple[int, int]]:
    """Links among one centre's sets, as many as join their labels."""
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    out, of = [], label.tolist()
    for i, j, share in tree_pairs(np.array([point(f) for f in flips]).reshape(-1, DIMENSIONS).astype(np.int32), sizes, side, label, limit):
        p, q = find(of[i]), find(of[j])
        if p != q and len(np.intersect1d(flips[i], flips[j], assume_unique=True)) >= share:
            parent[p] = q
            out.append((i, j))
    return out


def rest(deltas: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between sets of one centre that are of different components."""
    of_x, of_z = labels.select(F.col("node").alias("x"), F.col("label").alias("lx")), labels.select(F.col("node").alias("z"), F.col("label").alias("lz"))
    rows = deltas.join(of_x, "x", "left").join(of_z, "z", "left")
    rows = rows.select("z", "x", "n", "flips", F.coalesce("lx", "x").alias("label"), (F.coalesce("lx", "x") != F.coalesce("lz", "z")).alias("other"))
    rows = staged(rows, "labelled")

    size = F.octet_length("flips") / 8
    sums = [F.count_if("other").alias("o"), F.count_if(~F.col("other")).alias("m"), F.sum(F.when(F.col("other"), size).otherwise(0)).alias("fo"), F.sum(F.when(F.col("other"), 0).otherwise(size)).alias("fm")]
    groups = rows.groupBy("z").agg(*sums).where("o > 0 and o + m > 1")
    small = (F.col("o") + F.col("m") <= BLOCK_SETS) & (F.col("fo") + F.col("fm") <= BLOCK_FLIPS)

    def blocks(count: str, flips: str):
        return F.greatest(F.ceil(F.col(count) / BLOCK_SETS), F.ceil(F.col(flips) / BLOCK_FLIPS)).cast("int")

    groups = staged(groups.select("z", F.when(small, 0).otherwise(blocks("o", "fo")).alias("no"), F.when(small, 0).otherwise(blocks("m", "fm")).alias("nm"), (F.col("o") + F.col("m")).alias("size")), "groups")
    # Small groups are handled many at a time.
    batches = max(1, (groups.where("no = 0").agg(F.sum("size")).first()[0] or 0) // BLOCK_SETS)
    rows = rows.join(groups.hint("merge"), "z")
    few = rows.where("no = 0").select(F.pmod(F.xxhash64("z"), F.lit(batches)).alias("batch"), F.lit(0).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("j"), "z", "x", "n", "flips", "label", "other", F.lit(0).alias("block"))

    many = rows.where("no > 0").withColumn("block", F.pmod(F.xxhash64("x"), F.when(F.col("other"), F.col("no")).otherwise(F.greatest("nm", F.lit(1)))).cast("int"))
    each_o, each_m = F.sequence(F.lit(0), F.col("no") - 1), F.when(F.col("nm") > 0, F.sequence(F.lit(0), F.col("nm") - 1)).otherwise(F.array().cast("array<int>"))
    among = F.transform(each_o, lambda t: F.struct(F.lit(1).alias("kind"), F.least("block", t).alias("i"), F.greatest("block", t).alias("j")))
    across = F.transform(each_m, lambda t: F.struct(F.lit(2).alias("kind"), F.col("block").alias("i"), t.alias("j")))
    back = F.transform(each_o, lambda t: F.struct(F.lit(2).alias("kind"), t.alias("i"), F.col("block").alias("j")))
    many = many.withColumn("meet", F.explode(F.when(F.col("other"), F.concat(among, across)).otherwise(back)))
    many = many.select(F.col("z").alias("batch"), "meet.kind", "meet.i", "meet.j", "z", "x", "n", "flips", "label", "other", "block")
    limit = Threshold(num, den)

    def meet(group: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if group.num_rows:
            z, x, sizes, label, block = (group[c].to_numpy() for c in ("z", "x", "n", "label", "block"))
            other = group["other"].to_numpy().astype(bool)
            held = group["flips"].combine_chunks()
            kind, i, j = (group[c][0].as_py() for c in ("kind", "i", "j"))
            # Side 0 doesn't meet itself; 2 meets all.
            side = np.where(other, 2, 0) if kind == 0 else np.full(len(x), 2) if kind == 1 and i == j else (block == j).astype(np.int64) if kind == 1 else other.astype(np.int64)
            order = np.argsort(z, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(z[order])) + 1):
                flips = [np.frombuffer(held[r].as_buffer(), np.uint64) for r in own.tolist()]
                for a, b in joins(flips, sizes[own], side[own], label[own], limit):
                    out_a.append(x[own[a]])
                    out_b.append(x[own[b]])
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return few.unionByName(many).groupBy("batch", "kind", "i", "j").applyInArrow(meet, "a bigint, b bigint")


def linked(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sid) of every row, and the components of set ids as (node, label)."""
    made = staged(sets(docs, k, num, den), "sets")
    several = made.where("d1 is not null").groupBy("d1", "d2").agg(F.min("rid").alias("sid"), F.count("*").alias("m")).where("m > 1").select("d1", "d2", "sid")
    rows = made.select("doc_id", "rid", "k_id", "k_text", "n", "d1", "d2").join(staged(several, "several").hint("merge"), ["d1", "d2"], "left")
    rows = staged(rows.select("doc_id", "rid", "k_id", "k_text", "n", F.when(F.col("d1").isNotNull(), F.coalesce("sid", "rid")).alias("sid")), "rows")

    copies = staged(rows.where("sid <> rid").select("rid"), "copies")
    one = made.where("d1 is not null").join(copies, "rid", "left_anti")
    parts = [one.select(F.col("rid").alias("sid"), F.lit(p).alias("part"), spare, F.explode(cells).alias("cell")) for p, (spare, cells) in enumerate(((F.col("spare"), "cells"), (F.col("spare_next").alias("spare"), "cells_next")))]
    pairs = centred(parts[0].unionByName(parts[1]))
    discard(made)
    own = contents(docs, rows, pairs, k)
    deltas = compared(pairs, own, num, den)
    discard(own, pairs)
    links = deltas.where("linked").select(F.col("x").alias("a"), F.col("z").alias("b"))
    labels = components(links)
    more = staged(rest(deltas, labels, num, den), "links")
    discard(deltas)
    if not more.isEmpty():
        labels = components(more.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    return rows.select("doc_id", "n", "sid"), labels


def similar_documents(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of docs.

    A document's set holds its distinct shingles of k words (runs of anything but ASCII white
    space, A-Z lower-cased); with fewer words the whole sequence is its one shingle; without words
    or with null text the set is empty and linked with nothing. Two documents link when
    den * intersection >= num * union. component_id is the smallest doc_id reachable by links, the
    document's own included. Rows that share a doc_id and a text repeat; rows without an id link
    with nothing and have a null component_id. Other columns are ignored; an empty table gives no rows.
    """
    made, labels = linked(docs, k, num, den)
    rows = made.join(labels, made["sid"] == labels["node"], "left").select("doc_id", "n", F.coalesce("label", "sid").alias("class"))
    rows = staged(rows, "classed")
    least = rows.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    least = staged(least, "least").withColumnRenamed("class", "of_class")
    joined = rows.join(least, rows["class"] == least["of_class"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, all columns, with one document of each component: the one with the smallest doc_id.
    Rows without an id and documents without words stay. Rows that no sketch lets pass stay in place."""
    found = similar_documents(docs, k, num, den)
    gone = staged(found.where("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    return sketch.without(docs, "doc_id", gone)
