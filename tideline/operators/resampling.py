"""Permutations and bootstraps in blocks: arrays of values times matrices of draws, no row a replicate and item.

A draw is a 32-bit number that follows from seed, replicate and item alone (see ``functions.resample``), so a block may
be computed anywhere. Sums over flipped signs are partial: each Arrow batch gives one sum a replicate, whatever the size
of a group. Statistics that need a group's values together get them packed, once for each block of replicates. Groups of
over ``PACK`` rows, which no task should hold, take the statistic's own way: what decides a rank lies in a band of about
``BAND`` standard deviations around its expected place, which grows with the root of a group (``flipped_medians``) and
is searched by counts of ``CELLS`` cells first (``left_sums``); chunks of rows give counts and sums of all others. A
replicate whose rank falls outside its band is done again with a wider one. Moments of bootstrap samples are sums over
chunks of keys and tiles of values (``drawn_moments``); rank correlations take a group's arrays into a task for each
block of replicates (``gathered``), and groups beyond ``HELD`` rows are exploded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.resample import draws, item_key
from tideline.operators.ranges import running
from tideline.operators.tiles import batches_of
from tideline.sources.scan import written

#: Rows of a packed group, replicates of a block.
PACK, BLOCK = 20_000, 100
#: Groups whose sums a task holds; draws made at once.
GROUPS, DRAWS = 200, 1 << 17
#: Half a band, in standard deviations; cells of a band.
BAND, CELLS = 8.0, 64
#: Rows of a tile of values and of a chunk of keys in bootstrap moments; rows of a group whose arrays one task may hold.
TILE, CHUNK, HELD = 1 << 20, 1 << 16, 4_000_000


def _group(by: list[str]) -> Column:
    return F.struct(*[F.col(b) for b in by])


def _ungroup(by: list[str]) -> list[Column]:
    return [F.col(f"g.{b}").alias(b) for b in by]


def _listed(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), values)


def _block(rows: int) -> int:
    """Replicates whose draws for so many rows are made at once."""
    return max(1, min(BLOCK, DRAWS // max(rows, 1)))


def _summed(n: int):
    """One row for each group of a task, or for every ``GROUPS`` of its groups: sums by replicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: dict[int, tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
            sums = np.concatenate([x for _, x in held.values()])
            return pa.RecordBatch.from_arrays([pa.concat_arrays([g for g, _ in held.values()]), _listed(np.full(len(held), n), pa.array(sums))], ["g", "sums"])

        held: dict[int, tuple[pa.Array, np.ndarray]] = {}
        for batch in batches:
            key, value, of = (np.asarray(batch.column(c)) for c in ("key", "value", "of"))
            order = np.argsort(of, kind="stable")
            key, value = key[order], value[order]
            groups, first = np.unique(of[order], return_index=True)
            parts = [held.setdefault(x, (batch.column("g").slice(row, 1), np.zeros(n)))[1] for x, row in zip(groups.tolist(), order[first].tolist(), strict=True)]
            some = _block(len(key))
            for start in range(0, n, some):
                reps = slice(start, min(start + some, n))
                signed = np.where(draws(key, np.arange(reps.start, reps.stop)) < np.uint32(1 << 31), -value, value)
                for sums, s in zip(parts, np.add.reduceat(signed, first, axis=1).T, strict=True):
                    sums[reps] += s
            if len(held) > GROUPS:
                yield told(held)
                held = {}
        if held:
            yield told(held)

    return run


def flipped_sums(df: DataFrame, by: list[str], value: str, item: str, n: int, seed: int = 0, salt: str = "sign") -> DataFrame:
    """``by``, rep, s: the sum of randomly signed values in each of ``n`` replicates."""
    rows = df.where(F.col(value).isNotNull()).select(_group(by).alias("g"), item_key(seed, item, salt).alias("key"), F.col(value).cast("double").alias("value")).withColumn("of", F.xxhash64("g"))
    spark = df.sparkSession  # by number: rows are few, but each costs ``n`` draws
    rows = rows.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    parts = rows.mapInArrow(_summed(n), f"g {rows.schema['g'].dataType.simpleString()}, sums array<double>")
    return parts.select("g", F.posexplode("sums").alias("rep", "s")).groupBy("g", "rep").agg(F.sum("s").alias("s")).select(*_ungroup(by), "rep", "s")


def _packed(n: int, columns: list[str], kernel: Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(len(batch)):
                start = batch.column("start")[row].as_py()
                values = {c: np.asarray(batch.column(c)[row].values) for c in ("key", *columns)}
                reps = np.arange(start, min(start + BLOCK, n))
                out.append(kernel(values, draws(values["key"], reps)))
            at = np.repeat(np.arange(len(batch)), [len(x) for x in out])
            reps = np.concatenate([s + np.arange(len(x)) for s, x in zip(batch.column("start").to_pylist(), out, strict=True)]) if out else np.zeros(0)
            s = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("g").take(pa.array(at)), pa.array(reps, pa.int32()), pa.array(np.where(np.isfinite(s), s, 0), pa.float64(), mask=~np.isfinite(s))], ["g", "rep", "s"])

    return run


def replicated(df: DataFrame, by: list[str], columns: dict[str, Column], item: str, n: int, kernel: Callable, large: Callable[[DataFrame], DataFrame], seed: int = 0, salt: str = "boot") -> DataFrame:
    """``by``, rep, s: a statistic in each of ``n`` replicates.

    ``kernel`` takes a group's columns as arrays in the order of ``item`` (and "key") and a matrix of draws (replicates,
    rows), and gives one number a replicate (not finite: null). ``large`` does the same for the rows (by, item,
    columns) of groups with over ``PACK`` rows, as a table of by, rep, s.
    """
    rows = written(df.select(_group(by).alias("g"), F.col(item).alias("__item"), *[c.cast("double").alias(name) for name, c in columns.items()]))
    size = written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    few, many = size.where(F.col("n") <= PACK).select(F.col("g").alias("sg")), size.where(F.col("n") > PACK).select(F.col("g").alias("sg"))
    fields = F.sort_array(F.collect_list(F.struct("__item", item_key(seed, "__item", salt).alias("key"), *columns)))
    packed = rows.join(few, F.col("g") == F.col("sg"), "left_semi").groupBy("g").agg(fields.alias("x"))
    of = lambda name: F.transform("x", lambda r: r[name]).alias(name)
    packed = packed.select("g", of("key"), *[of(c) for c in columns], F.explode(F.expr(f"sequence(0, {n - 1}, {BLOCK})")).alias("start"))
    kind = rows.schema["g"].dataType.simpleString()
    with batches_of(df.sparkSession, 1):
        out = written(packed.repartition("g", "start").mapInArrow(_packed(n, list(columns), kernel), f"g {kind}, rep int, s double")).select(*_ungroup(by), "rep", "s")
    if many.isEmpty():
        return out
    rest = rows.join(many, F.col("g") == F.col("sg"), "left_semi").select(*_ungroup(by), F.col("__item").alias(item), *columns)
    return out.unionByName(large(rest))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk below a group's band and in each of its cells, by replicate."""
    for batch in batches:
        for row in range(len(batch)):
            low, high, width = (batch.column(c)[row].as_py() for c in ("low", "high", "width"))
            key, reps = (np.asarray(batch.column(c)[row].values) for c in ("key", "reps"))
            for start in range(0, len(reps), BLOCK):
                some = reps[start : start + BLOCK]
                h = draws(key, some)
                under = h < np.uint32(low)
                of, at = np.nonzero(~under & (h <= high - 1))  # the few rows of the band
                cell = (h[of, at].astype(np.int64) - low) // width
                n = np.c_[under.sum(1), np.bincount(of * CELLS + cell, minlength=len(some) * CELLS).reshape(-1, CELLS)]
                g = batch.column("g").take(pa.array(np.full(len(some), row)))
                yield pa.RecordBatch.from_arrays([g, pa.array(some, pa.int32()), _listed(np.full(len(some), CELLS + 1), pa.array(n.ravel(), pa.int64()))], ["g", "rep", "counts"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and sum of a chunk's rows below a replicate's cell, and the rows in it."""
    for batch in batches:
        for row in range(len(batch)):
            chunk = batch.column("chunk")[row].as_py()
            key, v, reps, lows, highs = (np.asarray(batch.column(c)[row].values) for c in ("key", "v", "reps", "lows", "highs"))
            for start in range(0, len(reps), BLOCK):
                part = slice(start, start + BLOCK)
                h = draws(key, reps[part]).astype(np.int64)
                under, inside = h < lows[part, None], (h >= lows[part, None]) & (h < highs[part, None])
                of, at = np.nonzero(inside)
                band = pa.StructArray.from_arrays([pa.array(h[of, at]), pa.array(chunk * PACK + at, pa.int64()), pa.array(v[at])], ["h", "i", "v"])
                g = batch.column("g").take(pa.array(np.full(len(h), row)))
                yield pa.RecordBatch.from_arrays([g, pa.array(reps[part], pa.int32()), pa.array(under.sum(1), pa.int64()), pa.array(np.where(under, v, 0).sum(1)), _listed(inside.sum(1), band)], ["g", "rep", "under", "s", "band"])


def left_sums(rows: DataFrame, by: list[str], item: str, n: int, seed: int = 0, salt: str = "label") -> DataFrame:
    """``by``, rep, low: in each of ``n`` replicates the sum of v over the rows with the smallest draws (ties by ``item``).

    There are as many such rows as the group's sum of lf says. For groups of any size; v isn't null.
    """
    placed = running(rows.select(_group(by).alias("g"), F.col(item).alias("__item"), "v", "lf"), ["g"], ["__item"], {"__at": ("sum", F.lit(1))})
    fields = F.sort_array(F.collect_list(F.struct("__at", item_key(seed, "__item", salt).alias("key"), F.col("v").cast("double").alias("v"))))
    of = lambda name: F.transform("x", lambda r: r[name]).alias(name)
    chunks = placed.withColumn("__at", F.coalesce("__at", F.lit(0)).cast("long")).groupBy("g", F.floor(F.col("__at") / PACK).alias("chunk")).agg(fields.alias("x")).select("g", "chunk", of("key"), of("v"))
    size = written(rows.groupBy(_group(by).alias("g")).agg(F.sum("lf").cast("long").alias("wanted"), F.count(F.lit(1)).alias("n")).where((F.col("wanted") > 0) & (F.col("wanted") < F.col("n"))))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks, left, out, z = written(chunks), size.withColumn("reps", F.sequence(F.lit(0), F.lit(n - 1))), None, BAND
    kind = rows.select(_group(by).alias("g")).schema["g"].dataType.simpleString()
    asked = lambda table: chunks.join(table.withColumnRenamed("g", "lg"), F.col("g") == F.col("lg")).drop("lg").repartition(parts, "g", "chunk")
    while True:
        share = F.col("wanted") / F.col("n")
        half = z * F.sqrt(share * (1 - share) / F.col("n")) + z / F.col("n")
        ends = left.withColumns({"low": (F.greatest(share - half, F.lit(0.0)) * 2**32).cast("long"), "high": (F.least(share + half, F.lit(1.0)) * 2**32).cast("long")})
        ends = written(ends.withColumn("width", F.ceil((F.col("high") - F.col("low")) / CELLS)))
        with batches_of(rows.sparkSession, 1):
            counts = asked(ends).mapInArrow(_counted, f"g {kind}, rep int, counts array<bigint>").select("g", "rep", F.posexplode("counts").alias("k", "c")).groupBy("g", "rep", "k").agg(F.sum("c").alias("c"))
            counts = counts.groupBy("g", "rep").agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("x")).join(ends.withColumnRenamed("g", "eg").drop("reps"), F.col("g") == F.col("eg"))
            reached = F.transform("x", lambda _, i: F.aggregate(F.slice("x", 1, i + 1), F.lit(0).cast("long"), lambda a, r: a + r["c"]) >= F.col("wanted"))
            told = written(counts.select("g", "rep", (F.array_position(reached, F.lit(True)) - 2).alias("cell"), "low", "high", "width"))
        cells = told.where("cell >= 0").select("g", F.struct("rep", (F.col("low") + F.col("cell") * F.col("width")).alias("low"), F.least("high", F.col("low") + (F.col("cell") + 1) * F.col("width")).alias("high")).alias("r"))
        cells = written(cells.groupBy("g").agg(F.sort_array(F.collect_list("r")).alias("r")).select("g", *[F.col(f"r.{c}").alias(f"{c}s") for c in ("rep", "low", "high")]))
        with batches_of(rows.sparkSession, 1):
            bands = asked(cells).mapInArrow(_banded, f"g {kind}, rep int, under long, s double, band array<struct<h:bigint,i:bigint,v:double>>")
            bands = bands.groupBy("g", "rep").agg(F.sum("under").alias("under"), F.sum("s").alias("s"), F.flatten(F.collect_list("band")).alias("band")).join(size.withColumnRenamed("g", "sg"), F.col("g") == F.col("sg"))
            first = F.slice(F.sort_array("band"), F.lit(1), (F.col("wanted") - F.col("under")).cast("int"))
            done = written(bands.select("g", "rep", (F.col("s") + F.aggregate(first, F.lit(0.0), lambda a, x: a + x["v"])).alias("low"))).select(*_ungroup(by), "rep", "low")
        out = done if out is None else out.unionByName(done)
        again = told.where("cell < 0")
        if again.isEmpty():
            return out
        again = again.groupBy("g").agg(F.sort_array(F.collect_list("rep")).alias("reps"))
        left, z = size.join(again.withColumnRenamed("g", "ag"), F.col("g") == F.col("ag")).drop("ag"), 8 * z


def _drawn(n: int, squares: bool):
    """Sums (and sums of squares) by replicate of the values that the draws of a chunk of keys pick from a tile of values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                size, tile = (batch.column(c)[row].as_py() for c in ("n", "tile"))
                key, v = (np.asarray(batch.column(c)[row].values) for c in ("key", "v"))
                whole, v = len(v) == size, np.r_[v, 0.0]
                s, q, some = np.zeros(n), np.zeros(n), _block(len(key))
                for start in range(0, n, some):
                    reps = slice(start, min(start + some, n))
                    at = picked(draws(key, np.arange(reps.start, reps.stop)), size)
                    if not whole:
                        at -= tile * TILE
                        at[(at < 0) | (at >= len(v))] = len(v) - 1  # of another tile
                    x = v[at]
                    s[reps] = x.sum(1)
                    if squares:
                        q[reps] = np.einsum("ij,ij->i", x, x)
                yield pa.RecordBatch.from_arrays([batch.column("g").slice(row, 1), _listed(np.array([n]), pa.array(s)), _listed(np.array([n]), pa.array(q))], ["g", "s", "q"])

    return run


def drawn_moments(rows: DataFrame, by: list[str], item: str, n: int, seed: int = 0, salt: str = "boot", squares: bool = True) -> DataFrame:
    """``by``, rep, mean, var (sample): of v over each of ``n`` bootstrap samples. For groups of any size; v isn't null.

    A draw picks the value at its share of the group's size, by ``item``. Keys go in chunks of ``CHUNK`` and values in tiles
    of ``TILE``; each chunk meets each tile of its group once, and gives one sum a replicate.
    """
    spark, of = rows.sparkSession, lambda c: F.transform(F.sort_array(F.collect_list(F.struct("at", c))), lambda r: r[c]).alias(c)
    placed = running(rows.select(_group(by).alias("g"), F.col(item).alias("__item"), F.col("v").cast("double").alias("v")), ["g"], ["__item"], {"at": ("sum", F.lit(1))})
    placed = written(placed.select("g", "v", item_key(seed, "__item", salt).alias("key"), F.coalesce("at", F.lit(0)).cast("long").alias("at")))
    size = written(placed.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m")).select(F.col("g").alias("sg"), "n", "m"))
    sized = placed.join(F.broadcast(size) if size.count() <= GROUPS else size, F.col("g") == F.col("sg"))
    tiles = sized.withColumn("v", F.col("v") - F.col("m")).groupBy("g", "n", F.floor(F.col("at") / TILE).alias("tile")).agg(of("v"))
    tiles = tiles.withColumn("tc", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))).withColumnRenamed("g", "tg")
    chunks = placed.groupBy("g", F.floor(F.col("at") / CHUNK).alias("chunk")).agg(of("key"))
    pairs = chunks.hint("shuffle_merge").join(tiles, (F.col("g") == F.col("tg")) & (F.col("chunk") == F.col("tc"))).select("g", "n", "tile", "key", "v")
    with batches_of(spark, 1):
        sums = written(pairs.mapInArrow(_drawn(n, squares), f"g {placed.schema['g'].dataType.simpleString()}, s array<double>, q array<double>"))
    each = sums.select("g", F.posexplode(F.arrays_zip("s", "q")).alias("rep", "z")).groupBy("g", "rep").agg(F.sum("z.s").alias("s"), F.sum("z.q").alias("q"))
    var = F.greatest((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0))
    return each.join(size, F.col("g") == F.col("sg")).select(*_ungroup(by), "rep", (F.col("m") + F.col("s") / F.col("n")).alias("mean"), var.alias("var"))


def gathered(rows: DataFrame, by: list[str], columns: list[str], item: str, n: int, kernel: Callable, seed: int = 0, salt: str = "boot") -> DataFrame:
    """``by``, rep, s: as ``replicated``, for groups of over ``PACK`` and up to ``HELD`` rows, in a task for each block of replicates.

    A task holds a group's arrays and ``_block`` replicates of draws; Spark's rows are chunks of ``PACK``.
    """
    placed = running(rows.select(_group(by).alias("g"), F.col(item).alias("__item"), *columns), ["g"], ["__item"], {"at": ("sum", F.lit(1))})
    placed = placed.select("g", item_key(seed, "__item", salt).alias("key"), *columns, F.coalesce("at", F.lit(0)).cast("long").alias("at"))
    packed = placed.groupBy("g", F.floor(F.col("at") / PACK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("at", "key", *columns))).alias("x"))
    names = ["key", *columns]
    packed = written(packed.select("g", "chunk", *[F.transform("x", lambda r: r[c]).alias(c) for c in names]))  # noqa: B023
    kind, spark = packed.schema["g"].dataType, rows.sparkSession

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk").combine_chunks()
        x = {c: np.concatenate([np.asarray(part.values) for part in table.column(c)]) for c in names}
        start, some, out = table.column("start")[0].as_py(), _block(len(x["key"])), []
        reps = np.arange(start, min(start + BLOCK, n))
        for k in range(0, len(reps), some):
            out.append(kernel(x, draws(x["key"], reps[k : k + some])))
        s = np.concatenate(out)
        g = table.column("g").combine_chunks().take(pa.array(np.zeros(len(s), int)))
        return pa.table([g, pa.array(reps, pa.int32()), pa.array(np.where(np.isfinite(s), s, 0), pa.float64(), mask=~np.isfinite(s))], names=["g", "rep", "s"])

    blocks = packed.withColumn("start", F.explode(F.expr(f"sequence(0, {n - 1}, {BLOCK})")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCK))
    return written(blocks.repartition(parts, "g", "start").groupBy("g", "start").applyInArrow(run, f"g {kind.simpleString()}, rep int, s double")).select(*_ungroup(by), "rep", "s")


def picked(h: np.ndarray, size: int) -> np.ndarray:
    """Row numbers that draws pick from so many rows."""
    return (h.astype(np.uint64) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def _median_of_band(x: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
    signed = np.sort(np.where(h < np.uint32(1 << 31), -x["v"], x["v"]), axis=1)
    at, m = np.arange(len(h)), signed.shape[1]
    low, high = x["low"], x["high"]
    inside = (low >= 0) & (high < m)
    return np.where(inside, (signed[at, np.clip(low, 0, m - 1)] + signed[at, np.clip(high, 0, m - 1)]) / 2, np.nan)


def flipped_medians(rows: DataFrame, by: list[str], item: str, n: int, seed: int = 0, salt: str = "sign") -> DataFrame:
    """``by``, rep, s: the median of randomly signed v in each of ``n`` replicates. For groups of any size; v isn't null.

    The median is among the values nearest to zero: of the others only the number of negative ones matters.
    """
    base = rows.select(_group(by).alias("g"), F.col(item).alias("__item"), F.col("v").cast("double").alias("v"), F.abs("v").alias("__far"), F.when(F.col("v") < 0, -1.0).otherwise(1.0).alias("__sign"))
    placed = written(running(base, ["g"], ["__far", "__item"], {"__at": ("sum", F.lit(1))}).withColumn("__at", F.coalesce("__at", F.lit(0))))
    size = written(placed.groupBy("g").agg(F.count(F.lit(1)).alias("n")).select(F.col("g").alias("sg"), "n"))
    out, z, kind = None, BAND, base.schema["g"].dataType.simpleString()
    of = lambda name: F.transform("x", lambda r: r[name]).alias(name)
    while True:
        told = placed.join(size, F.col("g") == F.col("sg")).drop("sg").withColumn("__near", F.col("__at") < F.least(F.ceil(z * F.sqrt("n")) + 1, F.col("n")))
        s = flipped_sums(told.where("not __near"), ["g"], "__sign", "__item", n, seed, salt)
        under = s.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("rep", "s"))), lambda r: r["s"]).alias("signs")).select(F.col("g").alias("ug"), "signs")
        under = written(under)  # before the batches of one row below
        fields = F.sort_array(F.collect_list(F.when(F.col("__near"), F.struct("__item", item_key(seed, "__item", salt).alias("key"), "v"))))
        band = told.where("__near").groupBy("g", "n").agg(fields.alias("x")).join(under, F.col("g") == F.col("ug"), "left")
        # the sum of signs of what lies outside gives how many of it are negative
        negative = F.transform(F.coalesce("signs", F.array_repeat(F.lit(0.0), n)), lambda t: ((F.col("n") - F.size("x") - t) / 2).cast("long"))
        band = band.select("g", of("key"), of("v"), "n", negative.alias("negative"), F.explode(F.expr(f"sequence(0, {n - 1}, {BLOCK})")).alias("start"))
        rank = lambda at, name: F.transform(F.slice("negative", F.col("start") + 1, BLOCK), lambda t: F.floor(at) - t).alias(name)
        packed = band.select("g", "start", "key", "v", rank((F.col("n") - 1) / 2, "low"), rank(F.col("n") / 2, "high"))
        with batches_of(rows.sparkSession, 1):
            told = written(packed.repartition("g", "start").mapInArrow(_packed(n, ["v", "low", "high"], _median_of_band), f"g {kind}, rep int, s double"))
        missed = written(told.where("s is null").select(F.col("g").alias("mg"), F.col("rep").alias("mr")))
        failed = missed.select("mg").distinct()
        done = told.join(failed, F.col("g") == F.col("mg"), "left_anti").select(*_ungroup(by), "rep", "s")
        out = done if out is None else out.unionByName(done)
        if missed.isEmpty():
            return out
        size, z = written(size.join(failed, F.col("sg") == F.col("mg"), "left_semi")), 8 * z
