"""Exact order statistics of groups of any size, by refining the ranges that hold the wanted ranks.

Groups of up to ``AT_ONCE`` rows are aggregated as they are. For larger ones, one pass counts the rows of ``CELLS`` cells
between a group's least and largest value; only cells that hold a wanted rank are looked at again, with the least and
largest value in them as new ends, until a cell holds one value or at most ``AT_ONCE`` rows, which are sorted then. What
a task holds is counts of cells, so it doesn't grow with a group; no pass shuffles raw rows, except those of the last cells.

Passes divide a range evenly and by powers of two in turn, so values spread over many magnitudes take few passes too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.sources.scan import written

CELLS, AT_ONCE = 1024, 10_000
#: Rows of a side of ranges up to which it is broadcast.
FEW = 100_000


def _cell(v: Column, lo: Column, hi: Column, by_powers: bool) -> Column:
    """The cell (0 to CELLS - 1) of a value between two different ends; never falls as the value grows."""
    scale = F.when(hi - lo == F.lit(float("inf")), 0.25).otherwise(1.0)
    share = (v * scale - lo * scale) / (hi * scale - lo * scale)
    if by_powers:  # by sign and binary order of magnitude, where the ends differ in that
        power = lambda x: F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1075))
        share = F.when(power(hi) > power(lo), (power(v) - power(lo)) / (power(hi) - power(lo))).otherwise(share)
    return F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).cast("int")


def _near(ranges: DataFrame, rows: int | None = None) -> DataFrame:
    return F.broadcast(ranges) if (ranges.count() if rows is None else rows) <= FEW else ranges


def _at(n: Column, q: float) -> Column:
    return (n - 1) * F.lit(float(q))


def _large(rows: DataFrame, head: DataFrame, quantiles: list[float]) -> DataFrame:
    """(g, q): array of the quantiles of each group of ``head`` (g, n, lo, hi); rows are (g, v)."""
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(_at(F.col("n"), q)), F.ceil(_at(F.col("n"), q))) for q in quantiles])))
    wanted = written(head.select("g", "n", F.explode(ranks).alias("r")))
    places = wanted.select(F.col("g").alias("wg"), "r")
    ranges = written(head.select("g", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("held")))
    done, turn = [], 0
    while True:
        wide = ranges.where((F.col("lo") < F.col("hi")) & (F.col("held") > AT_ONCE))
        done.append(ranges.where((F.col("lo") == F.col("hi")) | (F.col("held") <= AT_ONCE)))
        n = wide.count()
        if not n:
            break
        near = _near(wide.select(F.col("g").alias("rg"), "lo", "hi", "below"), n)
        inside = rows.join(near, (F.col("g") == F.col("rg")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        cells = inside.groupBy("g", "lo", "below", _cell(F.col("v"), F.col("lo"), F.col("hi"), turn % 2 == 1).alias("cell")).agg(F.count(F.lit(1)).alias("held"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.sum("held").over(Window.partitionBy("g", "lo").orderBy("cell")) - F.col("held") + F.col("below")  # CELLS rows at most
        told = cells.select("g", F.col("least").alias("lo"), F.col("most").alias("hi"), before.alias("below"), "held")
        hit = told.join(places, (F.col("g") == F.col("wg")) & (F.col("r") >= F.col("below")) & (F.col("r") < F.col("below") + F.col("held")), "left_semi")
        ranges, turn = written(hit), turn + 1
    ends = done[0]
    for x in done[1:]:
        ends = ends.unionByName(x)
    ends = written(ends)
    some = _near(ends.where("lo < hi").select(F.col("g").alias("rg"), "lo", "hi", "below"))
    sorted_ = rows.join(some, (F.col("g") == F.col("rg")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).groupBy("g", "below").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    one = ends.where("lo = hi").select("g", "below", "held", F.col("lo").alias("value"))
    values = one.join(places, (F.col("g") == F.col("wg")) & (F.col("r") >= F.col("below")) & (F.col("r") < F.col("below") + F.col("held"))).select("g", "r", "value")
    more = sorted_.join(places, (F.col("g") == F.col("wg")) & (F.col("r") >= F.col("below")) & (F.col("r") < F.col("below") + F.size("vs"))).select("g", "r", F.get("vs", (F.col("r") - F.col("below")).cast("int")).alias("value"))
    of = values.unionByName(more).join(wanted.select(F.col("g").alias("wg"), "n", F.col("r").alias("wr")), (F.col("g") == F.col("wg")) & (F.col("r") == F.col("wr"))).groupBy("g").agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("r", "value"))).alias("m"))
    out = []
    for q in quantiles:
        at = _at(F.col("n"), q)
        low, high = (F.element_at("m", f(at)) for f in (F.floor, F.ceil))
        out.append(F.when(F.floor(at) == F.ceil(at), low).otherwise(low * (F.ceil(at) - at) + high * (at - F.floor(at))))
    return of.select("g", F.array(*out).alias("q"))


def _quantiles(rows: DataFrame, quantiles: list[float]) -> DataFrame:
    """(g, q) for a written table of (g, v) without nulls."""
    head = written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    at_once = lambda df: df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(float(q)) for q in quantiles])).alias("q"))
    large = head.where(F.col("n") > AT_ONCE)
    if large.isEmpty():
        return at_once(rows)
    most = _near(large.select(F.col("g").alias("lg"), F.lit(1).alias("is")))
    small = rows.join(most, F.col("g") == F.col("lg"), "left_anti")
    of_large = rows.join(most, F.col("g") == F.col("lg"), "left_semi")
    return at_once(small).unionByName(_large(of_large, large, quantiles))


def quantiles(df: DataFrame, by: list[str], columns: dict[str, Column], wanted: dict[str, float], deviation: str | None = None) -> DataFrame:
    """``by`` and, for each of ``columns`` and each of ``wanted``, the exact quantile <column>_<name> (linear between ranks).

    With ``deviation``, the median of absolute deviations from the median too, as <column>_<deviation>. Nulls are
    left out; a group without values has nulls; null keys are a group. Groups may have any size.
    """
    key = F.struct(*[F.col(b) for b in by]) if by else F.struct(F.lit(0).alias("all"))
    names = list(columns)
    long = df.select(key.alias("k"), F.explode(F.array(*[F.struct(F.lit(i).alias("c"), columns[c].cast("double").alias("v")) for i, c in enumerate(names)])).alias("x"))
    long = written(long.select(F.struct("k", "x.c").alias("g"), "x.v"))
    rows = long.where("v is not null")
    out = _quantiles(rows, list(wanted.values())).select("g", F.col("q"))
    if deviation is not None:
        both = written(out)
        centre = both.select(F.col("g").alias("cg"), F.element_at("q", list(wanted.values()).index(0.5) + 1).alias("m"))
        gaps = written(rows.join(_near(centre), F.col("g") == F.col("cg")).select("g", F.abs(F.col("v") - F.col("m")).alias("v")))
        out = both.join(_quantiles(gaps, [0.5]).select(F.col("g").alias("dg"), F.col("q").alias("d")), F.col("g") == F.col("dg")).select("g", F.concat("q", "d").alias("q"))
    ends = [*wanted, *([deviation] if deviation else [])]
    wide = out.groupBy("g.k").agg(*[F.max(F.when(F.col("g.c") == i, F.element_at("q", j + 1))).alias(f"{c}_{name}") for i, c in enumerate(names) for j, name in enumerate(ends)])
    groups = long.select("g.k").distinct()
    every = groups.join(wide.withColumnRenamed("k", "wk"), F.col("k") == F.col("wk"), "left")
    return every.select(*([F.col(f"k.{b}").alias(b) for b in by]), *[f"{c}_{name}" for c in names for name in ends])
