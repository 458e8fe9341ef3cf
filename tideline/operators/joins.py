"""Null-safe composite joins, paired joins, as-of and interval joins, neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import tiles
from tideline.operators.ranges import running


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null meets null; keys come out once."""
    r = right.select(*[F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    joined = left.join(r, on, how)
    if how in ("left_semi", "left_anti"):
        return joined
    both = [F.coalesce(F.col(k), F.col(f"__{k}")).alias(k) for k in keys]
    return joined.select(*both, *[c for c in left.columns if c not in keys], *[c for c in r.columns if not c.startswith("__")])


def paired(df: DataFrame, keys: list[str], left: Column, right: Column, value: str = "value") -> DataFrame:
    """Mean of each side per pairing key in one aggregation; keys with both sides stay."""
    sides = df.groupBy(*keys).agg(F.avg(F.when(left, F.col(value))).alias("left"), F.avg(F.when(right, F.col(value))).alias("right"))
    return sides.where("left is not null and right is not null")


def asof_nearest(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, tolerance: float, key: str, ties: list[str]) -> DataFrame:
    """For each left row the nearest right row within ``tolerance`` (inclusive), the earlier on ties.

    A merge: both sides in one order of time, where each left row sees the last right row before it and the first
    after it (see ``running``). No left row is repeated, and times may be as dense as they like.
    """
    r = right.where(F.col(right_time).isNotNull()).groupBy(F.col(by).alias("__by"), F.col(right_time).alias("__t")).agg(F.min(F.struct(F.col(right_time).alias("t"), *ties)).alias("__r"))  # one of equal times
    empty = F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType)
    rows = r.select("__by", F.col("__t").cast("double").alias("__t"), F.lit(0).alias("__side"), "__r", empty.alias("__l"))
    rows = rows.unionByName(left.where(F.col(left_time).isNotNull()).select(F.col(by).alias("__by"), F.col(left_time).cast("double").alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.struct(*left.columns).alias("__l")))
    met = running(rows, ["__by"], ["__t", "__side"], {"__p": ("max", F.col("__r"))}, {"__f": ("min", F.col("__r"))}).where("__side = 1")
    gap = lambda x: F.abs(F.col(f"{x}.t") - F.col(f"__l.{left_time}"))
    near = F.when(F.coalesce(gap("__p") <= gap("__f"), F.col("__f").isNull()), F.col("__p")).otherwise(F.col("__f"))
    near = met.withColumn("__n", near).withColumn("__n", F.when(F.abs(F.col("__n.t") - F.col(f"__l.{left_time}")) <= tolerance, F.col("__n")))
    out = near.select("__l.*", F.col("__n.t").alias(f"near_{right_time}"), *[F.col(f"__n.{t}").alias(f"near_{t}") for t in ties])
    timeless = left.where(F.col(left_time).isNull())
    return out.unionByName(timeless.select("*", *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns[len(left.columns) :]]))


def _edges(windows: DataFrame, points: DataFrame, by: str, start: str, length: float, time: str, key: str) -> DataFrame:
    """(__by, __t, __kind, __k, __p): starts (0) and ends (1) of windows, and points (2), which follow edges of their time."""
    w = windows.select(F.col(by).alias("__by"), F.col(start).cast("double").alias("__s"), F.col(key).alias("__k"))
    p = points.select(F.col(by).alias("__by"), F.col(time).cast("double").alias("__t"), F.struct("*").alias("__p")).where("__t is not null")
    edge = lambda at, kind: w.select("__by", at.alias("__t"), F.lit(kind).alias("__kind"), "__k", F.lit(None).cast(p.schema["__p"].dataType).alias("__p"))
    return edge(F.col("__s"), 0).unionByName(edge(F.col("__s") + length, 1)).where("__t is not null").unionByName(p.select("__by", "__t", F.lit(2).alias("__kind"), F.lit(None).cast(w.schema["__k"].dataType).alias("__k"), "__p"))


def interval_count(windows: DataFrame, points: DataFrame, by: str, start: str, length: float, time: str, key: str) -> DataFrame:
    """Number of points in [start, start + length) of each window, 0 when none.

    A sweep over edges and points in the order of time: points before the end minus points before the start. A window
    is two rows, however many points it holds.
    """
    swept = running(_edges(windows, points.select(by, time), by, start, length, time, key), ["__by"], ["__t", "__kind"], {"__n": ("sum", F.when(F.col("__kind") == 2, 1).otherwise(0))})
    n = swept.where("__kind < 2").groupBy("__k").agg(F.sum(F.when(F.col("__kind") == 1, F.col("__n")).otherwise(-F.col("__n"))).alias("n_inside"))
    return windows.join(n, windows[key] == F.col("__k"), "left").drop("__k").withColumn("n_inside", F.coalesce("n_inside", F.lit(0)).cast("long"))


def lookup(windows: DataFrame, series: DataFrame, by: str, center: str, index: str) -> DataFrame:
    """The series' columns at each window's centre; centres out of range go."""
    s = series.withColumnRenamed(index, center)
    return windows.join(s, [by, center])


def annotate(df: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """Condition from the annotation where there is one, the former one in condition_original; re-runnable."""
    base = df.withColumn("condition", F.coalesce("condition_original", "condition")) if "condition_original" in df.columns else df
    base = base.drop("condition_original", "depth")
    n = notes.select(*keys, F.col("condition").alias("__c"), "depth")
    return base.join(n, keys, "left").withColumn("condition_original", F.col("condition")).withColumn("condition", F.coalesce("__c", "condition")).drop("__c")


def neighbours(df: DataFrame, by: list[str], index: str, axes: list[str], k: int) -> DataFrame:
    """(by, index, neighbour, dist2, rank): the k nearest points of each point in its session, itself included.

    Sessions may have any number of points (see ``tiles``). Ties go by index.
    """
    return tiles.nearest(df, by, index, axes, k)


def pair_distances(df: DataFrame, by: str, index: str, axes: list[str]) -> DataFrame:
    """Mean and largest distance over all pairs of a trajectory, from sums over pairs of tiles."""
    return tiles.pair_sums(df, [by], index, axes).select(by, "mean_dist", "max_dist")


def stage_of_windows(windows: DataFrame, points: DataFrame, by: str, start: str, length: float, time: str, key: str, code: str, order: str) -> DataFrame:
    """The code of the last point (by ``order``, which needn't be that of time) in each window, -1 when none.

    Time is cut into stretches as long as a window. A window is the rest of one and the beginning of the next (or all of
    one), so its last point is the later of a running maximum from behind at its start and one from the front at its end.
    """
    edges = _edges(windows, points.select(by, time, code, order), by, start, length, time, key)
    # the end's stretch is the one after its start's, whatever rounding says
    stretch = F.floor(F.when(F.col("__kind") == 1, F.col("__t") - length).otherwise(F.col("__t")) / F.lit(float(length))) + F.when(F.col("__kind") == 1, 1).otherwise(0)
    point = F.when(F.col("__kind") == 2, F.struct(F.col(f"__p.{order}").alias("o"), F.col(f"__p.{code}").alias("c")))
    met = running(edges.withColumn("__s", stretch), ["__by", "__s"], ["__t", "__kind"], {"__a": ("max", point)}, {"__z": ("max", point)})
    last = met.where("__kind < 2").groupBy("__k").agg(F.max(F.when(F.col("__kind") == 0, F.col("__z")).otherwise(F.col("__a"))).alias("__m"))
    return windows.join(last.select("__k", F.col("__m.c").alias("stage")), windows[key] == F.col("__k"), "left").drop("__k").withColumn("stage", F.coalesce("stage", F.lit(-1)))


def listed(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the sample."""
    return df.join(sample.select(key).distinct(), key, "left_semi")
