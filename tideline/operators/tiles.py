"""Distances within keys of any size: points packed into tiles, and pairs of tiles as Arrow batches.

``pair_sums`` reduces every pair of tiles to a sum, a maximum and counts; no row a pair of points is ever made.
``nearest`` finds the k nearest points exactly: tiles are cells of a grid of quantiles, a tile's own points bound how far
its neighbours can be, and only tiles whose boxes lie within that bound meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.sources.scan import written

#: Points of a tile (cells with more are divided), pairs of tiles in an Arrow batch, quantiles that a grid has at most.
TILE, PAIRS, GRID = 1024, 64, 64
#: Points of a key that is one row, of which so many meet all others at once.
WHOLE, CHUNK = 4096, 256
#: Distances are compared after rounding to nine places.
SLACK = 1.1e-9


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows in the jobs that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, held)


def _points(df: DataFrame, by: list[str], index: str, axes: list[str]) -> DataFrame:
    """(g, id, x) of the rows that have all axes."""
    x = F.array(*[F.col(a).cast("double") for a in axes])
    g = F.struct(*[F.col(b) for b in by]) if by else F.struct(F.lit(0).alias("all"))
    return df.select(g.alias("g"), F.col(index).cast("long").alias("id"), x.alias("x")).where(~F.exists("x", lambda v: v.isNull()))


def _packed(points: DataFrame, *keys: str) -> DataFrame:
    """A row for each key: ids and xs (point after point) in the same order."""
    return points.groupBy(*keys).agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("x")).alias("xs"))


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, ends = np.asarray(column.values), np.asarray(column.offsets)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all of ``y``, summed axis by axis."""
    out = np.zeros((len(x), len(y)))
    for a in range(x.shape[1]):
        out += (x[:, a, None] - y[None, :, a]) ** 2
    return out


def _reduced(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y, same, limit in zip(_lists(batch.column("xs")), _lists(batch.column("ys")), batch.column("same").to_pylist(), batch.column("within").to_pylist(), strict=True):
                dist = np.sqrt(_squares(x.reshape(-1, d), y.reshape(-1, d)))
                dist = dist[np.triu_indices(len(dist), 1)] if same else dist.ravel()
                out.append((float(dist.sum()), float(dist.max(initial=0)), len(dist), int((dist <= limit).sum()) if limit is not None else 0))
            total, far, n, close = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(total, pa.float64()), pa.array(far, pa.float64()), pa.array(n, pa.int64()), pa.array(close, pa.int64())], ["g", "total", "far", "n", "close"])

    return run


def pair_sums(df: DataFrame, by: list[str], index: str, axes: list[str], near: float | None = None) -> DataFrame:
    """``by``, pairs, mean_dist, max_dist of all pairs of a key's points, and with ``near`` how many are within near * max_dist.

    Points with a null axis are left out; keys with fewer than two points have no row. ``index`` tells the points of a
    key apart.
    """
    tile = F.floor(F.col("id") / TILE)
    tiles = written(_packed(_points(df, by, index, axes).withColumn("tile", tile), "g", "tile"))
    other = tiles.select(F.col("g").alias("h"), F.col("tile").alias("beside"), F.col("xs").alias("ys"))
    kind = tiles.schema["g"].dataType

    def reduced(limits: DataFrame | None) -> DataFrame:
        pairs = tiles.join(other, (F.col("g") == F.col("h")) & (F.col("tile") <= F.col("beside")))
        if limits is None:
            pairs = pairs.withColumn("within", F.lit(None).cast("double"))
        else:
            pairs = pairs.join(limits.select(F.col("g").alias("lg"), (F.col("far") * near).alias("within")), F.col("g") == F.col("lg"))
        rows = pairs.select("g", "xs", "ys", (F.col("tile") == F.col("beside")).alias("same"), "within").mapInArrow(_reduced(len(axes)), f"g {kind.simpleString()}, total double, far double, n long, close long")
        with batches_of(df.sparkSession, PAIRS):
            return written(rows.groupBy("g").agg(F.sum("total").alias("total"), F.max("far").alias("far"), F.sum("n").alias("n"), F.sum("close").alias("close")).where("n > 0"))

    got = reduced(None)
    if near is not None:
        got = reduced(got)
    keys = [F.col(f"g.{b}").alias(b) for b in by]
    return got.select(*keys, F.col("n").alias("pairs"), (F.col("total") / F.col("n")).alias("mean_dist"), F.col("far").alias("max_dist"), *([F.col("close")] if near is not None else []))


def _bounded(d: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kth, reach = [], []
            for x in _lists(batch.column("xs")):
                x = x.reshape(-1, d)
                own = np.partition(_squares(x, x), k - 1, axis=1)[:, k - 1] if len(x) >= k else np.full(len(x), np.inf)
                kth.append(own)
                reach.append(float(own.max(initial=0)))
            columns = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kth, pa.list_(pa.float64())), pa.array(reach, pa.float64())], [*batch.schema.names, "kth", "reach"])

    return run


def _chosen(x: np.ndarray, y: np.ndarray, others: np.ndarray, limit: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, id, squared distance) of what may be among the k nearest of each row: at most ``limit`` away, or the k-th."""
    squares = _squares(x, y)
    if limit is None:
        limit = np.partition(squares, k - 1, axis=1)[:, k - 1] if len(y) >= k else np.full(len(x), np.inf)
    at, to = np.nonzero(squares <= limit[:, None] + SLACK)
    far = squares[at, to]
    order = np.lexsort((others[to], far, at))
    at, to, far = at[order], to[order], far[order]
    start = np.searchsorted(at, np.arange(len(x)))
    rank = np.arange(len(at)) - start[at]
    last = far[np.minimum(start[at] + k - 1, len(far) - 1)] if len(far) else far
    keep = (rank < k) | ((far <= last + SLACK) & (far != last))  # equal ones beyond the k-th have larger ids
    return at[keep], others[to[keep]], far[keep]


def _found(batch: pa.RecordBatch, parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows (g, id, neighbour, dist2) from (row of the batch, ids, neighbours, distances)."""
    at = np.concatenate([np.full(len(p[1]), p[0]) for p in parts])
    columns = [pa.array(np.concatenate([p[i] for p in parts]), kind) for i, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()))]
    return pa.RecordBatch.from_arrays([batch.column("g").take(pa.array(at)), *columns], ["g", "id", "neighbour", "dist2"])


def _best(d: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides, parts = zip(*(_lists(batch.column(c)) for c in ("ids", "xs", "kth", "others", "ys")), strict=True), []
            for row, ((own, x, kth, others, y), reach) in enumerate(zip(sides, batch.column("reach").to_pylist(), strict=True)):
                at, near, far = _chosen(x.reshape(-1, d), y.reshape(-1, d), others, np.minimum(kth, reach), k)
                parts.append((row, own[at], near, far))
            if parts:
                yield _found(batch, parts)

    return run


def _whole(d: int, k: int):
    """The same for keys that are one row: a few hundred of its points against all of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for row, (ids, x) in enumerate(zip(_lists(batch.column("ids")), _lists(batch.column("xs")), strict=True)):
                x = x.reshape(-1, d)
                for start in range(0, len(x), CHUNK):
                    at, near, far = _chosen(x[start : start + CHUNK], x, ids, None, k)
                    parts.append((row, ids[start + at], near, far))
            if parts:
                yield _found(batch, parts)

    return run


def _gap(lo: str, hi: str, lo2: str, hi2: str, axes: int) -> Column:
    """Squared distance between two boxes."""
    gaps = [F.greatest(F.col(lo2)[a] - F.col(hi)[a], F.col(lo)[a] - F.col(hi2)[a], F.lit(0.0)) for a in range(axes)]
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])


def _span(lo: str, hi: str, lo2: str, hi2: str, axes: int) -> Column:
    """Squared distance that no two points of two boxes exceed."""
    spans = [F.greatest(F.col(hi2)[a] - F.col(lo)[a], F.col(hi)[a] - F.col(lo2)[a]) for a in range(axes)]
    return sum((s * s for s in spans[1:]), spans[0] * spans[0])


def nearest(df: DataFrame, by: list[str], index: str, axes: list[str], k: int) -> DataFrame:
    """``by``, index, neighbour, dist2 (rounded to nine places) and rank: the k nearest points of each, itself included.

    Ties go by index. Points with a null axis are left out and found by nobody; keys with fewer than k points give all.
    Keys of up to ``WHOLE`` points are a row each; larger ones go by tiles.
    """
    points, d = _points(df, by, index, axes), len(axes)
    size = written(points.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    large = size.where(F.col("n") > WHOLE).select(F.col("g").alias("lg"))
    shape = f"g {points.schema['g'].dataType.simpleString()}, id long, neighbour long, dist2 double"
    with batches_of(df.sparkSession, 1):
        if large.isEmpty():
            found = written(_packed(points, "g").mapInArrow(_whole(d, k), shape))
        else:
            points = written(points)
            rest = points.join(large, F.col("g") == F.col("lg"), "left_anti")
            found = written(_packed(rest, "g").mapInArrow(_whole(d, k), shape)).unionByName(_by_tiles(points.join(large, F.col("g") == F.col("lg"), "left_semi"), d, k))
    found = found.withColumn("dist2", F.round("dist2", 9))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("g", "id").orderBy("dist2", "neighbour"))).where(F.col("rank") <= k)
    return ranked.select(*[F.col(f"g.{b}").alias(b) for b in by], F.col("id").alias(index), "neighbour", "dist2", "rank")


def _by_tiles(points: DataFrame, d: int, k: int) -> DataFrame:
    """(g, id, neighbour, dist2): candidates of the k nearest of each point (g, id, x), all of them among these."""
    spark, cut_axes = points.sparkSession, min(3, d)
    points = written(points)
    grid = [i / GRID for i in range(1, GRID)]
    size = points.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(F.col("x")[a], F.array(*[F.lit(q) for q in grid]), F.lit(1000)).alias(f"cuts{a}") for a in range(cut_axes)])
    size = size.withColumn("s", F.least(F.ceil(F.pow(F.col("n") / TILE, F.lit(1 / cut_axes))), F.lit(GRID))).select(F.col("g").alias("sg"), "s", *[f"cuts{a}" for a in range(cut_axes)])
    # a point's slab on each axis: how many quantiles it reaches, in s even parts
    placed = points.join(size, F.col("g") == F.col("sg"))
    slab = lambda a: F.floor(F.size(F.filter(F.col(f"cuts{a}"), lambda c: c <= F.col("x")[a])) * F.col("s") / GRID).cast("int")
    placed = written(placed.select("g", "id", "x", *[slab(a).alias(f"s{a}") for a in range(cut_axes)]))
    cell = ["g", *[f"s{a}" for a in range(cut_axes)]]
    full = placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts")).where("parts > 1").select(*[F.col(c).alias(f"f_{c}") for c in cell], "parts")
    parted = placed.join(full, [F.col(c) == F.col(f"f_{c}") for c in cell], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)))
    box = [F.array(*[f(F.col("x")[a]) for a in range(d)]).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    tiles = parted.groupBy(*cell, "part").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("x")).alias("xs"), *box)
    tiles = tiles.select("g", "s0", F.struct(*[c for c in cell if c != "g"], "part").alias("tile"), "ids", "xs", "lo", "hi")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiles.schema)
    with batches_of(spark, PAIRS):
        tiles = written(tiles.mapInArrow(_bounded(d, k), shape + ", kth array<double>, reach double"))
    boxes = tiles.select("g", "s0", "tile", "lo", "hi", F.size("ids").alias("m"), "reach")
    # a tile of fewer than k points is bounded by the farthest point of a larger one of its key
    anchor = boxes.where(F.col("m") >= k).groupBy(F.col("g").alias("ag")).agg(F.max_by(F.struct("lo", "hi"), "m").alias("a")).select("ag", F.col("a.lo").alias("alo"), F.col("a.hi").alias("ahi"))
    bound = F.when(F.col("m") >= k, F.col("reach")).otherwise(F.coalesce(_span("lo", "hi", "alo", "ahi", d), F.lit(float("inf")))) * (1 + 1e-12) + SLACK
    asking = boxes.join(anchor, F.col("g") == F.col("ag"), "left").select("g", "tile", "lo", "hi", bound.alias("reach"))
    slabs = boxes.groupBy(F.col("g").alias("bg"), F.col("s0").alias("b0")).agg(F.min(F.col("lo")[0]).alias("from"), F.max(F.col("hi")[0]).alias("to"))
    aside = F.greatest(F.col("from") - F.col("hi")[0], F.col("lo")[0] - F.col("to"), F.lit(0.0))
    met = asking.join(slabs, (F.col("g") == F.col("bg")) & (aside * aside <= F.col("reach")))
    other = boxes.select(F.col("g").alias("og"), F.col("s0").alias("o0"), F.col("tile").alias("other"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"))
    met = met.join(other, (F.col("g") == F.col("og")) & (F.col("b0") == F.col("o0"))).where(_gap("lo", "hi", "olo", "ohi", d) <= F.col("reach")).select(F.col("g").alias("mg"), F.col("tile").alias("mt"), "other", "reach")
    pairs = written(met)
    first = tiles.select("g", "tile", "ids", "xs", "kth").join(pairs, (F.col("g") == F.col("mg")) & (F.col("tile") == F.col("mt"))).drop("mg", "mt")
    second = tiles.select(F.col("g").alias("og"), F.col("tile").alias("ot"), F.col("ids").alias("others"), F.col("xs").alias("ys"))
    both = first.join(second, (F.col("g") == F.col("og")) & (F.col("other") == F.col("ot"))).select("g", "ids", "xs", "kth", "others", "ys", "reach")
    with batches_of(spark, PAIRS):
        return written(both.mapInArrow(_best(d, k), f"g {tiles.schema['g'].dataType.simpleString()}, id long, neighbour long, dist2 double"))
