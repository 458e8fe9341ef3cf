"""N-gram Jaccard join: documents whose word-shingle sets are similar, and the components that links form.

Shingles are hashed into groups, and a document's set becomes a point of group counts. For sets A and B,
|A n B| <= sum of min(a_g, b_g), and for boxes of points the same holds with their upper corners; so points, and
whole nodes of an R-tree over points, that are too far apart can't be linked. The exact sets decide what is left.

One tree over all points can't find candidates: unrelated texts of one length have nearly equal counts, and boxes
only tell them apart with about one group for 16 shingles, where boxes of a tree overlap everywhere (README). The
points are therefore first dealt into cells by their exact position along runs of fine groups: in size class c (sizes
from 2^c to 2^(c+1) - 1) hashes are cut into m_c consecutive runs, and a cell is a run with its content. Sets of sizes
a <= b that are linked differ in at most D(a) shingles, as b is at most a / threshold; so at most D(a) of the runs that
A fills differ, and among the first D(a) + 1 of them one is the same in B, and within B's first D(b) + 1. A document
goes to the cells of its first D + 1 filled runs, in its own class and, if a larger partner may be there, in the next. A
set that fills fewer runs goes to all of them, and to its empty ones among the first D + 1. No link is lost.

Each text is read once for name (128 bits of its set), point and cells; from there on equal sets are one item.

1. Within a cell every item is paired with the cell's smallest; the bound by summed minima drops pairs, exact sets
   decide the rest, and links form components. A family of copies costs pairs in proportion to its size.
2. Cells that still hold several components are joined with themselves by R-trees. Cells of the same members count
   once. Members of a cell with up to ``LEAF`` items are one leaf; items of larger cells are dealt into leaves by the
   smallest item they meet and by size, once for all their cells; pairs of leaves that meet in a cell are pruned by
   their boxes. Inside a pair of leaves nodes are packed sort-tile-recursively (size, then the count that spreads
   most), pairs of nodes are pruned by their boxes, points by theirs, and the exact sets decide.
3. Links of both steps form the components.

Cases: null, empty and wordless texts have an empty set and link with nothing, not even each other; texts with fewer
words than a shingle are one shingle; repeated rows are equal sets; a null id belongs to its set's component;
ties can't arise, components are named by the smallest doc_id; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import HOT_ROWS, attach, batches_of, boxed, cut, discard, small

GROUPS, LEAF, NODE, CHUNK = 512, 256, 16, 1 << 20
#: Items of leaves that are unpacked at once.
UNPACKED = 4096
#: Bytes of a row group of tables with long rows (sets, cells, leaves).
GROUP_BYTES = 16 << 20
#: Edges of components that a task takes.
EDGES = 100_000
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
DEPTH = 64
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
#: A random number for each byte at each of the first places of a word; a word's hash is the sum of its bytes' numbers.
TABLE = _mix((np.arange(DEPTH, dtype=np.uint64)[:, None] * np.uint64(256) + LOWER + np.uint64(1)) * M1).ravel()


def _hash_words(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every word of ``raw`` (UTF-8 bytes); texts begin at ``starts``."""
    ink = ~SPACE[raw]
    at = np.flatnonzero(ink)
    if not len(at):
        return np.zeros(0, np.uint64), at
    new = np.ones(len(raw) + 1, bool)
    new[1:-1] = ~ink[:-1]
    new[starts] = True
    head = np.flatnonzero(new[at])
    place = at - np.repeat(at[head], np.diff(np.append(head, len(at))))
    letters = raw[at]
    value = TABLE[np.minimum(place, DEPTH - 1) * 256 + letters]
    far = place >= DEPTH
    if far.any():
        value[far] = _mix((place[far].astype(np.uint64) * np.uint64(256) + LOWER[letters[far]] + np.uint64(1)) * M1)
    return np.add.reduceat(value, head), at[head]


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that stand one after another and end at ``ends``, and the number of words of each.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Long texts are hashed in pieces.
    """
    edges = np.concatenate([[0], ends])
    hashes, places, lo = [], [], 0
    with np.errstate(over="ignore"):
        while lo < len(raw):
            hi = min(lo + 2 * CHUNK, len(raw))
            while hi < len(raw):  # end at white space or a text's end, so no word is cut
                back = np.flatnonzero(SPACE[raw[lo:hi]])
                edge = edges[np.searchsorted(edges, hi, side="right") - 1]
                stop = max(lo + int(back[-1]) + 1 if len(back) else lo, int(edge))
                if stop > lo:
                    hi = stop
                    break
                hi = min(hi + 2 * CHUNK, len(raw))
            inside = edges[(edges >= lo) & (edges < hi)] - lo
            h, at = _hash_words(raw[lo:hi], inside)
            hashes.append(h)
            places.append(at + lo)
            lo = hi
    places = np.concatenate(places) if places else np.zeros(0, np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.diff(np.searchsorted(places, edges))


def shingle_sets(raw: np.ndarray, ends: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct ``k``-word shingle hashes of each text; fewer words are one shingle, none an empty set."""
    h, sizes = word_hashes(raw, ends)
    out = []
    with np.errstate(over="ignore"):
        n = max(len(h) - k + 1, 0)
        s = np.zeros(n, np.uint64)
        for j in range(k):
            s = s * M3 + h[j : n + j]
        s = _mix(s)
        for end, size in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
            if size < k:
                y = np.full(min(size, 1), size, np.uint64)
                for v in h[end - size : end]:
                    y = y * M1 + v
                out.append(_mix(y + M2))
                continue
            x = np.sort(s[end - size : end - k + 1])
            new = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=new[1:])
            out.append(x[new])
    return out


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and ends) of an Arrow column; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def _batches(parts: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of batches with few bytes each (a longer text is alone), with the shingle sets of their texts."""
    for part in parts:
        raw, at = _texts(part.column("text"))
        lo = 0
        while lo < len(part):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, side="right")) - 1)
            yield part.slice(lo, hi - lo), shingle_sets(raw[at[lo] : at[hi]], at[lo + 1 : hi + 1] - at[lo], k)
            lo = hi


def pack_point(s: np.ndarray) -> bytes:
    """Counts of a set's hashes in ``GROUPS`` groups, in as many bytes each as the largest needs."""
    counts = np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    most = counts.max(initial=0)
    return counts.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32).tobytes()


def unpack_points(column: pa.Array) -> np.ndarray:
    """A row of counts for each point of an Arrow column."""
    raw, at = _texts(column)
    size, out = np.diff(at), np.zeros((len(at) - 1, GROUPS), np.int32)
    for kind in (np.uint8, np.uint16, np.uint32):
        width = GROUPS * np.dtype(kind).itemsize
        here = np.flatnonzero(size == width)
        if len(here):
            out[here] = np.ascontiguousarray(raw[at[here][:, None] + np.arange(width)]).view(kind)
    return out


def _both_ways(x: DataFrame, a: str, b: str) -> DataFrame:
    return x.select(a, b).union(x.select(F.col(b).alias(a), F.col(a).alias(b)))


class Join:
    """Sets of ``k``-word shingles, linked when 100 * |A n B| >= ``percent`` * |A u B|; ``percent`` is over 50."""

    def __init__(self, k: int = 5, percent: int = 80):
        if not 50 < percent <= 100:
            raise ValueError("percent must be over 50")
        self.k, self.percent = k, percent
        self.runs = np.array([1 + (d := self.differ(2 ** (c + 1) - 1)) + (d + 7) // 8 for c in range(40)], np.int64)

    def differ(self, n):
        """The largest symmetric difference of a set of ``n`` with a linked one that is as large or larger."""
        return (n + n * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def enough(self, overlap, both):
        """Whether sets with ``overlap`` common shingles and ``both`` in all, counted twice where common, are linked."""
        return 100 * overlap >= self.percent * (both - overlap)

    def cells(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(cells, number of each set's cells)."""
        n = np.array([len(s) for s in sets], np.int64)
        kind = np.frexp(np.maximum(n, 1))[1].astype(np.int64) - 1
        found, owner = [], []
        for up in (0, 1):
            chosen = np.flatnonzero((n > 0) & ((n * 100 // self.percent >= 2 ** (kind + 1)) | (up == 0)))
            if not len(chosen):
                continue
            c, sizes, most = kind[chosen] + up, n[chosen], self.differ(n[chosen]) + 1
            s = np.concatenate([sets[i] for i in chosen])
            own = np.repeat(np.arange(len(chosen)), sizes)
            with np.errstate(over="ignore"):
                run = ((s >> np.uint64(32)) * self.runs[c].astype(np.uint64)[own]) >> np.uint64(32)
                first = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (own[1:] != own[:-1])]))
                held = np.add.reduceat(_mix(s + M1), first)
                whose, run = own[first], run[first]
                filled = np.bincount(whose, minlength=len(chosen))
                nth = np.arange(len(first)) - np.repeat(np.cumsum(filled) - filled, filled)
                keep = nth < most[whose]
                for i in np.flatnonzero(filled < most):  # few runs filled: the empty ones among the first count too
                    empty = np.setdiff1d(np.arange(most[i], dtype=np.uint64), run[whose == i])
                    held, run = np.concatenate([held, np.zeros(len(empty), np.uint64)]), np.concatenate([run, empty])
                    whose, keep = np.concatenate([whose, np.full(len(empty), i)]), np.concatenate([keep, np.ones(len(empty), bool)])
                held, run, whose = held[keep], run[keep], whose[keep]
                found.append(_mix(_mix(held + c[whose].astype(np.uint64) * M2) + (run + np.uint64(1)) * M1))
                owner.append(chosen[whose])
        if not found:
            return np.zeros(0, np.uint64), np.zeros(len(sets), np.int64)
        owner = np.concatenate(owner)
        return np.concatenate(found)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(sets))

    def describe(self, documents: DataFrame) -> DataFrame:
        """(doc_id, row, n, name, point, cells): hash of the text; size, 128-bit name, point and cells of its set."""

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, sets in _batches(parts, self.k):
                cells, number = self.cells(sets)
                ends = np.concatenate([[0], np.cumsum(number)]).astype(np.int32)
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                columns = [
                    part.column("doc_id"), part.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()),
                    pa.array([pack_point(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(cells.view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n", "name", "point", "cells"])

        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
        return rows.mapInArrow(run, "doc_id long, row long, n long, name binary, point binary, cells array<long>")

    def fetch(self, documents: DataFrame, items: DataFrame, wanted: DataFrame) -> DataFrame:
        """(id, shingles): the hashes, as packed numbers, of the ``wanted`` items, from the texts that stand for them."""

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, sets in _batches(parts, self.k):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"])

        of = small(cut(items.join(wanted, "id", "left_semi").select("id", F.col("doc_id").alias("d"), F.col("row").alias("r"))))
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
        rows = rows.join(of, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))).select("id", "text")
        with batches_of(documents.sparkSession, 500, read=True):
            return cut(rows.mapInArrow(run, "id long, shingles binary").dropDuplicates(["id"]), GROUP_BYTES)

    def within_bound(self, pairs: DataFrame, items: DataFrame) -> DataFrame:
        """The (a, b) of ``pairs`` whose summed minima of counts still allow a link."""

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                x, y = unpack_points(part.column("p")), unpack_points(part.column("q"))
                keep = self.enough(np.minimum(x, y).sum(1), x.sum(1) + y.sum(1))
                yield part.select(["a", "b"]).filter(pa.array(keep))

        sizes = items.select("id", "n", "point")
        rows = cut(attach(pairs, sizes.select(F.col("id").alias("a"), F.col("n").alias("m"), F.col("point").alias("p")), "a"))
        both = rows.join(sizes.select(F.col("id").alias("b"), "n", F.col("point").alias("q")), "b")
        both = both.where(self.enough(F.least("n", "m"), F.col("n") + F.col("m")))
        return cut(both.select("a", "b", "p", "q").mapInArrow(run, "a long, b long"))

    def links(self, documents: DataFrame, items: DataFrame, pairs: DataFrame) -> DataFrame:
        """The (a, b) of ``pairs`` that are linked, by their exact sets."""

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                keep = []
                for x, y in zip(part.column("x"), part.column("y"), strict=True):
                    s, u = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    keep.append(bool(self.enough(len(np.intersect1d(s, u, assume_unique=True)), len(s) + len(u))))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        sets = self.fetch(documents, items, _both_ways(pairs, "a", "b").select(F.col("a").alias("id")).distinct())
        with batches_of(documents.sparkSession, 200, read=True):
            half = cut(attach(pairs, sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a"), GROUP_BYTES)
            both = half.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
            out = cut(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
        discard(half, sets)
        return out

    def classes(self, documents: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        return self._placed(documents).select("doc_id", "n_shingles", "component_id")

    def _placed(self, documents: DataFrame) -> DataFrame:
        """(doc_id, row, n_shingles, component_id, first, copies) of every row.

        first is the (doc_id, row) that stands for its component, copies the number of rows with this doc_id and row.
        """
        with batches_of(documents.sparkSession, 500, read=True):
            described = cut(self.describe(documents), GROUP_BYTES)
        place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")  # null ids last
        sets = described.where("n > 0").groupBy("name").agg(F.min(place).alias("first"))
        sets = cut(sets.select(F.monotonically_increasing_id().alias("id"), "name", "first"))
        stands = small(cut(sets.select("id", F.col("first.doc_id").alias("d"), F.col("first.row").alias("r"))))
        chosen = described.join(stands, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")))
        with batches_of(documents.sparkSession, 500, read=True):  # the cells of a long text are a long row
            items = cut(chosen.select("id", "doc_id", "row", "n", "point").dropDuplicates(["id"]))
            members = self._members(chosen.select("id", F.explode("cells").alias("cell")))
        rows = cut(described.select("doc_id", "row", "n", "name"))
        discard(described)

        pairs = cut(members.select(F.col("low").alias("a"), F.col("id").alias("b")).distinct())
        near = self.within_bound(pairs, items)
        links = self.links(documents, items, near)
        labels = cut(components(links))
        more = self.cross_pairs(members, labels, items)
        more = cut(more.join(near, ["a", "b"], "left_anti"))
        discard(members, pairs)
        if not more.isEmpty():
            more = self.links(documents, items, more)
            if not more.isEmpty():
                known = labels.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))
                labels = cut(components(known.union(more)))

        named = sets.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        least = named.groupBy("label").agg(F.min("first").alias("stands"))
        of = cut(attach(cut(named.select("name", "label")), least, "label").select("name", "stands"))
        out = attach(rows.where("n > 0"), of, "name").select("doc_id", "row", "n", F.struct("stands.doc_id", "stands.row").alias("first"))
        out = out.unionByName(rows.where("n = 0").select("doc_id", "row", "n"), allowMissingColumns=True)
        return out.select("doc_id", "row", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"), "first")

    def _members(self, dealt: DataFrame) -> DataFrame:
        """(cell, low, id) of each item of a cell but its smallest, low, from (id, cell).

        One shuffle: the smallest item of a cell comes first in a window, others are paired with it as they come. Cells
        that a 64th of the items shows to hold over ``HOT_ROWS`` of them don't go there: their smallest items are found by
        partial aggregation and broadcast. All items are paired either way.
        """
        seen = dealt.where(F.pmod(F.xxhash64("id"), F.lit(64)) == 0).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS / 64)
        hot = cut(seen.select(F.col("cell").alias("hot")))
        met = Window.partitionBy("cell").orderBy("id")
        if hot.isEmpty():
            rest = dealt
        else:
            rest, often = (dealt.join(small(hot), F.col("cell") == F.col("hot"), how) for how in ("left_anti", "left_semi"))
            lows = small(cut(often.groupBy(F.col("cell").alias("at")).agg(F.min("id").alias("low"))))
            often = often.join(lows, F.col("cell") == F.col("at")).where("low < id").select("cell", "low", "id").distinct()
        paired = rest.select("cell", "id", F.first("id").over(met).alias("low"), F.lag("id").over(met).alias("before")).where("before < id").select("cell", "low", "id")
        return cut(paired if hot.isEmpty() else paired.union(often))

    def cross_pairs(self, members: DataFrame, labels: DataFrame, items: DataFrame) -> DataFrame:
        """(a, b) of items in one cell but different components, that the bound by summed minima leaves open."""
        held = members.select("cell", "id").union(members.select("cell", F.col("low").alias("id")).distinct())
        held = cut(held.join(labels, "id", "left").select("cell", "id", F.coalesce("label", "id").alias("label")))
        mark = F.xxhash64("id")
        open_ = held.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("l"), F.max("label").alias("h"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 20)).alias("y"))
        open_ = cut(open_.where("l < h and size > 2").groupBy("size", "x", "y").agg(F.min("cell").alias("cell")).select("cell", "size"))  # cells of the same members count once
        held = cut(attach(held, open_, "cell"))
        # an item with few in common of any partner's size can't be linked: sizes and points go along
        point = items.select("id", "n", "point")
        within = held.where(F.col("size") <= LEAF).select("cell", "id", "label")
        within = within.join(point, "id").groupBy("cell").agg(F.collect_list(F.struct("id", "label", "n", "point")).alias("x"))
        near = within.select("x").mapInArrow(self._trees(("x", "x")), "a long, b long")

        large = held.where(F.col("size") > LEAF)
        with batches_of(items.sparkSession, 100, read=True):  # a leaf is a row of 130 KB and more
            if not large.isEmpty():
                near = near.union(self._between_leaves(large, members, point))
            return cut(near.distinct())

    def _between_leaves(self, large: DataFrame, members: DataFrame, point: DataFrame) -> DataFrame:
        """(a, b) as ``cross_pairs`` gives them, of cells with more than one leaf's items."""
        lows = members.join(large.select("cell").distinct(), "cell", "left_semi").groupBy("cell").agg(F.min("low").alias("low"))
        met = cut(attach(cut(large.select("cell", "id", "label")), lows, "cell"))
        tied = met.groupBy("id").agg(F.min("label").alias("label"), F.min("low").alias("hub")).join(point, "id")
        # linked sets' sizes differ by no more than the threshold's ratio: neighbouring size bands only
        band = F.floor(F.log("n") / F.lit(-math.log(self.percent / 100) * (1 + 1e-6))).cast("int") if self.percent < 100 else F.lit(0)
        tied = cut(tied.withColumn("band", band))
        many = small(cut(tied.groupBy("hub", "band").agg(F.ceil(F.count(F.lit(1)) / LEAF).cast("int").alias("leaves"))))
        placed = cut(tied.join(many, ["hub", "band"]).withColumn("leaf", F.xxhash64("hub", "band", F.pmod(F.xxhash64("id"), F.col("leaves")))))
        leaves = cut(placed.groupBy("leaf").agg(F.collect_list(F.struct("id", "label", "n", "point")).alias("x")), GROUP_BYTES)
        boxes = cut(leaves.mapInArrow(self._boxes, "leaf long, low binary, high binary, least long, most long"))

        beside = cut(met.select("cell", "id").join(placed.select("id", "leaf", "band"), "id").select("cell", "leaf", "band").distinct())
        other = beside.select("cell", F.col("leaf").alias("other"), F.col("band").alias("beside"))
        meet = beside.join(other, "cell").where((F.abs(F.col("band") - F.col("beside")) <= 1) & (F.col("leaf") <= F.col("other"))).select("leaf", "other").distinct()
        second = boxes.select(*[F.col(c).alias(f"{c}_2") for c in boxes.columns]).withColumnRenamed("leaf_2", "other")
        meet = cut(meet.join(boxes, "leaf").join(second, "other").mapInArrow(self._open_boxes, "leaf long, other long"))
        rows = cut(meet.join(leaves, "leaf"), GROUP_BYTES).join(leaves.select(F.col("leaf").alias("other"), F.col("x").alias("y")), "other")
        return rows.select("x", "y").mapInArrow(self._trees(("x", "y")), "a long, b long")

    def _boxes(self, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for leaf, x in zip(part.column("leaf"), _leaves(part.column("x")), strict=True):
                out.append((leaf.as_py(), x["point"].min(0).tobytes(), x["point"].max(0).tobytes(), int(x["n"].min()), int(x["n"].max())))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["leaf", "low", "high", "least", "most"])

    def _open_boxes(self, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            box = {c: np.stack([np.frombuffer(v.as_buffer(), np.int32) for v in part.column(c)]) if len(part) else np.zeros((0, GROUPS), np.int32) for c in ("low", "high", "low_2", "high_2")}
            n = {c: part.column(c).to_numpy() for c in ("least", "most", "least_2", "most_2")}
            keep = self._may_meet(box["low"], box["high"], n["least"], n["most"], box["low_2"], box["high_2"], n["least_2"], n["most_2"])
            yield part.select(["leaf", "other"]).filter(pa.array(keep))

    def _may_meet(self, low, high, least, most, low2, high2, least2, most2) -> np.ndarray:
        """Whether boxes (last axis: groups) can hold linked points.

        The overlap is at most the summed minima of upper corners, and at most half of what sizes leave beyond the gaps
        between the boxes.
        """
        corners = np.minimum(high, high2).sum(-1)
        gaps = np.maximum(np.maximum(low - high2, low2 - high), 0).sum(-1)
        ratio = (100 * most2 >= self.percent * least) & (100 * most >= self.percent * least2)
        return ratio & self.enough(corners, least + least2) & self.enough((most + most2 - gaps) / 2, most + most2)

    def _trees(self, sides: tuple[str, str]):
        """A function over batches with a leaf in each of two columns (or the same one twice): pairs left open."""
        same = sides[0] == sides[1]

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                a, b = [], []
                left = _leaves(part.column(sides[0]))
                for x, y in ((x, x) for x in left) if same else zip(left, _leaves(part.column(sides[1])), strict=True):
                    i, j = self.open_pairs(x, y)
                    a.append(np.minimum(x["id"][i], y["id"][j]))
                    b.append(np.maximum(x["id"][i], y["id"][j]))
                    if sum(map(len, a)) > 1 << 16:
                        yield _pairs(a, b)
                        a, b = [], []
                yield _pairs(a, b)

        return run

    def open_pairs(self, x: dict, y: dict) -> tuple[np.ndarray, np.ndarray]:
        """Places (i, j) of points of different labels in two leaves that the bounds leave open."""
        if len(x["id"]) <= NODE and len(y["id"]) <= NODE:
            tiles = [(np.arange(len(x["id"])), np.arange(len(y["id"])))]
        else:
            nodes = [pack_nodes(side["n"], side["point"]) for side in (x, y)]
            low, high, least, most = zip(*[[np.stack([f(side["point"][t], 0) for t in ts]) for f in (np.min, np.max)] + [np.array([f(side["n"][t]) for t in ts]) for f in (np.min, np.max)] for side, ts in zip((x, y), nodes, strict=True)], strict=True)
            meet = self._may_meet(low[0][:, None], high[0][:, None], least[0][:, None], most[0][:, None], low[1][None], high[1][None], least[1][None], most[1][None])
            tiles = [(nodes[0][p], nodes[1][q]) for p, q in zip(*np.nonzero(meet), strict=True)]
        rows, columns = [], []
        for i, j in tiles:
            apart = (x["label"][i][:, None] != y["label"][j][None]) & (x["id"][i][:, None] != y["id"][j][None])
            both = x["n"][i][:, None] + y["n"][j][None]
            p, q = np.nonzero(apart & self.enough(np.minimum(x["n"][i][:, None], y["n"][j][None]), both))
            if x is y:
                once = x["id"][i[p]] < y["id"][j[q]]
                p, q = p[once], q[once]
            if len(p):
                keep = self.enough(np.minimum(x["point"][i[p]], y["point"][j[q]]).sum(1), both[p, q])
                rows.append(i[p[keep]])
                columns.append(j[q[keep]])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(rows or none), np.concatenate(columns or none)

    def one_of_each(self, documents: DataFrame) -> DataFrame:
        """``documents`` with one document of each component: the one it is named by; repeated rows count as one.

        A document is known by its id and its text, so unrelated texts with one id, null too, all stay.
        """
        c = cut(self._placed(documents).where("n_shingles > 0"))
        stands = F.col("doc_id").cast("long").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))
        names = [F.col("doc_id").alias("__as"), F.col("row").alias("__text")]
        gone = cut(c.where(~stands).select(*names).distinct())
        repeated = cut(c.where(stands).groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(*names))
        fate = small(cut(gone.withColumn("__fate", F.lit(1)).union(repeated.withColumn("__fate", F.lit(2)))))
        rows = boxed(documents).withColumns({"__id": F.col("__doc.doc_id").cast("long"), "__row": F.xxhash64("__doc.text")})
        marked = rows.join(fate, F.col("__id").eqNullSafe(F.col("__as")) & (F.col("__row") == F.col("__text")), "left")
        kept = marked.where("__fate is null")
        if not repeated.isEmpty():
            again = marked.where("__fate = 2").groupBy("__id", "__row").agg(F.min_by("__doc", F.xxhash64(F.to_json("__doc"))).alias("__doc"))
            kept = kept.union(again.select(*marked.columns[:1], *[F.lit(None) for _ in marked.columns[1:]]))
        return kept.select("__doc.*")


def _leaves(column: pa.Array) -> Iterator[dict]:
    """id, label, n and point of each row's list of items, as arrays; a few lists are unpacked at once."""
    at = column.offsets.to_numpy() - column.offsets.to_numpy()[0] if len(column) else np.zeros(1, np.int64)
    items, lo = column.flatten(), 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + UNPACKED, side="right")) - 1)
        some = items.slice(at[lo], at[hi] - at[lo])
        ids, labels, n, points = some.flatten()
        whole = {"id": ids.to_numpy(), "label": labels.to_numpy(), "n": n.to_numpy(), "point": unpack_points(points)}
        for i in range(lo, hi):
            yield {c: v[at[i] - at[lo] : at[i + 1] - at[lo]] for c, v in whole.items()}
        lo = hi


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    none = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v or none).astype(np.int64)) for v in (a, b)], ["a", "b"])


def pack_nodes(n: np.ndarray, point: np.ndarray) -> list[np.ndarray]:
    """Sort-tile packing: slabs by size, nodes of ``NODE`` points in each by the count that spreads most."""
    order = np.argsort(n, kind="stable")
    slab = NODE * max(1, round(math.sqrt(len(n) / NODE)))
    out = []
    for lo in range(0, len(order), slab):
        part = order[lo : lo + slab]
        part = part[np.argsort(point[part, point[part].var(0).argmax()], kind="stable")]
        out += [part[i : i + NODE] for i in range(0, len(part), NODE)]
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every linked item: the smallest one in its component, by large and small stars until they settle.

    Edges are read in as many partitions as their number asks for, so a few edges don't cost a task for each of the
    session's shuffle partitions in every round.
    """
    state = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).alias("s")

    def packed(edges: DataFrame) -> tuple:
        now = edges.agg(state).first()["s"]
        return edges.coalesce(max(1, -(-now["n"] // EDGES))), now

    written = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    edges, before = packed(written)
    while True:
        # large star: larger neighbours go to the smallest one; where that is the item itself nothing changes
        moves = _both_ways(edges, "u", "v").coalesce(max(1, -(-before["n"] // EDGES))).groupBy("u").agg(F.min("v").alias("m")).where("m < u").select(F.col("u").alias("at"), "m")
        by_end = edges.select(F.col("v").alias("at"), "u")
        large = cut(attach(by_end, moves, "at", "left").select("u", F.coalesce("m", "at").alias("v")).distinct())
        # small star: an item and its smaller neighbours go to the smallest of them
        some = large.coalesce(max(1, -(-before["n"] // EDGES)))
        least = some.groupBy("u").agg(F.min("v").alias("m"))
        after = attach(some, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(after.union(least.select("u", F.col("m").alias("v"))).where("u <> v").coalesce(max(1, -(-before["n"] // EDGES))).distinct())
        discard(written, large)
        written = after
        edges, now = packed(after)
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())
        before = now
