"""Robust statistics, summaries by session, stage and feature, pivots, inventories and histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators.filters import finite
from tideline.operators.quantiles import quantiles


def finite_stats(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """n_total, n_finite, finite_frac, mean, median, std (population) of each column's finite values."""
    clean = df.select(*by, *[finite(F.col(c)).alias(c) for c in columns])
    aggs = [F.count(F.lit(1)).alias("n_total")]
    for c in columns:
        aggs += [F.count(c).alias(f"{c}_n_finite"), (F.count(c) / F.count(F.lit(1))).alias(f"{c}_finite_frac"), F.avg(c).alias(f"{c}_mean"), F.median(c).alias(f"{c}_median"), F.stddev_pop(c).alias(f"{c}_std")]
    out = clean.groupBy(*by).agg(*aggs)
    return out.withColumn("finite_ok", reduce(lambda a, b: a & b, [F.col(f"{c}_n_finite") == F.col("n_total") for c in columns]))


def spread(df: DataFrame, by: list[str], column: str, large: bool = False) -> DataFrame:
    """A2: n, mean, median, std, mad, iqr, min, max; the median is joined back for the absolute deviations.

    ``large``: keys may have very many rows; quartiles and deviations come from refined ranges (see ``quantiles``).
    """
    clean = df.select(*by, finite(F.col(column)).alias("v"))
    on = lambda p: reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"{p}{b}")) for b in by])
    aggs = [F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")]
    if large:
        order = quantiles(df, by, {"v": finite(F.col(column))}, {"q25": 0.25, "median": 0.5, "q75": 0.75}, "mad")
        order = order.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("v_median").alias("median"), (F.col("v_q75") - F.col("v_q25")).alias("iqr"), F.col("v_mad").alias("mad"))
        return clean.groupBy(*by).agg(*aggs).join(order, on("__")).select(*by, "n", "mean", "median", "std", "mad", "iqr", "min", "max")
    first = clean.groupBy(*by).agg(*aggs, F.median("v").alias("median"), (F.percentile("v", F.lit(0.75)) - F.percentile("v", F.lit(0.25))).alias("iqr"))
    centre = first.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("median").alias("__median"))
    mad = clean.join(centre, on("__")).groupBy(*[f"__{b}" for b in by]).agg(F.median(F.abs(F.col("v") - F.col("__median"))).alias("mad"))
    return first.join(mad, on("__")).select(*by, "n", "mean", "median", "std", "mad", "iqr", "min", "max")


def feature_summary(long: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """A3: per key and feature of a long table (feature, value); std of the sample."""
    s = spread(long, [*by, "feature"], "value").drop("std", "n")
    more = long.select(*by, "feature", finite(F.col("value")).alias("v")).groupBy(*by, "feature").agg(
        F.stddev_samp("v").alias("std"), F.percentile("v", F.lit(0.05)).alias("p05"), F.percentile("v", F.lit(0.95)).alias("p95"),
        (F.count("v") / F.count(F.lit(1))).alias("finite_frac"), (F.count("v") == F.count(F.lit(1))).alias("finite_ok"), (F.count("v") < least).alias("not_testable"),
    )
    return s.join(more, [*by, "feature"])


def complete_rows(long: DataFrame, by: list[str], index: str, stage: str, least: int = 20) -> DataFrame:
    """A4: rows of indices at which every feature is finite, of stages with at least ``least`` such indices."""
    per = long.groupBy(*by, index, stage).agg((F.count(finite(F.col("value"))) == F.count(F.lit(1))).alias("ok")).where("ok")
    stages = per.groupBy(*by, stage).agg(F.count(F.lit(1)).alias("kept")).where(F.col("kept") >= least)
    good = per.join(stages, [*by, stage], "left_semi").select(*by, index)
    return long.join(good, [*by, index], "left_semi")


def stage_summary(df: DataFrame, stage: str, subject: str, block: str, columns: list[str]) -> DataFrame:
    """Per stage distinct subjects, distinct (subject, block), windows, mean and median of each column.

    A stage is a large part of all windows: its medians come from refined ranges.
    """
    aggs = [F.count_distinct(subject).alias("n_subjects"), F.count_distinct(subject, block).alias("n_blocks"), F.count(F.lit(1)).alias("n_windows")]
    out = df.groupBy(stage).agg(*aggs, *[F.avg(c).alias(f"{c}_mean") for c in columns])
    middle = quantiles(df, [stage], {c: F.col(c) for c in columns}, {"median": 0.5}).withColumnRenamed(stage, "__stage")
    return out.join(middle, F.col(stage).eqNullSafe(F.col("__stage"))).drop("__stage")


def medians(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """A10: median of each column by key."""
    return df.groupBy(*by).agg(*[F.median(c).alias(c) for c in columns])


def pivot(df: DataFrame, by: list[str], column: str, values: list, aggregate: Column, need_all: bool = False, fill=None) -> DataFrame:
    """Long to wide over stated values; optionally only keys that have them all, or missing cells filled."""
    wide = df.groupBy(*by).pivot(column, values).agg(aggregate)
    wide = wide.dropna(subset=[str(v) for v in values]) if need_all else wide
    return wide if fill is None else wide.fillna(fill, [str(v) for v in values])


def first_known(df: DataFrame, by: list[str], columns: list[str], order: str) -> DataFrame:
    """The first non-blank text of each column by key, in row order."""
    return df.groupBy(*by).agg(*[F.min_by(c, F.when(F.length(F.trim(F.col(c))) > 0, F.col(order))).alias(c) for c in columns])


def keep_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (which must be total)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def keep_best(df: DataFrame, by: list[str], effect: str = "effect", tie: str = "id") -> DataFrame:
    """The best row per key by q, p, then the largest absolute effect; nulls last."""
    return keep_first(df, by, [F.col("q").asc_nulls_last(), F.col("p").asc_nulls_last(), F.abs(F.col(effect)).desc_nulls_last(), F.col(tie)])


def inventory(df: DataFrame, session: str, anchor: str, finite_flag: str, label: str) -> DataFrame:
    """Windows in total and by label, of which anchored and finite, sessions; the total has label '*'."""
    aggs = [F.count_distinct(session).alias("sessions"), F.count(F.lit(1)).alias("windows"), F.sum(F.coalesce(F.col(anchor), F.lit(False)).cast("long")).alias("anchored"), F.sum(F.coalesce(F.col(finite_flag), F.lit(False)).cast("long")).alias("finite")]
    both = df.groupBy(label).agg(*aggs).unionByName(df.agg(*aggs).withColumn(label, F.lit("*")))
    return both.withColumn("anchored_frac", F.col("anchored") / F.col("windows")).withColumn("finite_frac", F.col("finite") / F.col("windows"))


def capabilities(df: DataFrame, manifest: str, paths: dict[str, str]) -> DataFrame:
    """One number (else 0) and a has_ flag for each JSON path of a manifest column."""
    out = df
    for name, path in paths.items():
        out = out.withColumn(name, F.coalesce(F.get_json_object(manifest, path).cast("long"), F.lit(0))).withColumn(f"has_{name}", F.get_json_object(manifest, path).isNotNull())
    return out


def qc_summary(df: DataFrame, by: list[str], subject: str) -> DataFrame:
    """Rows, distinct subjects and mean of the flags with their defaults."""
    flag = lambda c, default: F.avg(F.coalesce(F.col(c), F.lit(default)).cast("double")).alias(f"{c}_rate")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(subject).alias("n_subjects"), flag("finite_ok", True), flag("not_testable", False), flag("validity_limited", False))


def run_qc(blocks: DataFrame, metrics: DataFrame, tests: DataFrame) -> DataFrame:
    """Three kinds of summary in one table; columns that a kind lacks are null."""
    m = metrics.groupBy("analysis_type", "metric_role").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("value").isNotNull().cast("double")).alias("value_rate")).withColumn("kind", F.lit("metrics"))
    t = tests.groupBy("contrast_name", "analysis_type").agg(F.count(F.lit(1)).alias("n_tests"), F.median("n_pairs").alias("median_pairs"), F.sum((F.col("q_value") <= 0.05).cast("long")).alias("n_significant")).withColumn("kind", F.lit("tests"))
    return blocks.withColumn("kind", F.lit("block")).unionByName(m, allowMissingColumns=True).unionByName(t, allowMissingColumns=True)


def coverage(df: DataFrame, by: list[str], flags: list[str], columns: list[str]) -> DataFrame:
    """Rows, pass rates, share of non-null values, mean and std (sample) by key."""
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(F.col(f).cast("double")).alias(f"{f}_rate") for f in flags]
    for c in columns:
        aggs += [F.avg(F.col(c).isNotNull().cast("double")).alias(f"{c}_filled"), F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return df.groupBy(*by).agg(*aggs)


def metric_triple(long: DataFrame, by: list[str], metrics: list[str], labels: dict[str, str], condition: str = "condition") -> DataFrame:
    """Median of several metrics per key, keys that have them all; condition labels are recoded."""
    out = long.groupBy(*by).agg(*[F.median(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]).dropna(subset=metrics)
    recode = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return out.withColumn(condition, F.coalesce(F.element_at(recode, F.col(condition)), F.col(condition)))


def occupancy(df: DataFrame, by: list[str], axes: list[str], cells: int) -> DataFrame:
    """Counts in a grid of ``cells`` per axis over each key's own range (plus 1e-9)."""
    r = df.groupBy(*by).agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))])
    at = lambda a: F.least(F.floor((F.col(a) - F.col(f"lo_{a}")) / (F.col(f"hi_{a}") - F.col(f"lo_{a}") + 1e-9) * cells), F.lit(cells - 1)).cast("int")
    return df.join(r, by).select(*by, *[at(a).alias(f"i{k}") for k, a in enumerate(axes)]).groupBy(*by, *[f"i{k}" for k in range(len(axes))]).agg(F.count(F.lit(1)).alias("n"))


def smooth(grid: DataFrame, by: list[str], cells: int, kernel: list[float], value: str = "n") -> DataFrame:
    """Separable smoothing of a sparse grid (i0, i1, i2) with clamped edges."""
    radius = len(kernel) // 2
    taps = F.array(*[F.struct(F.lit(k - radius).alias("off"), F.lit(float(w)).alias("w")) for k, w in enumerate(kernel)])
    out = grid.select(*by, "i0", "i1", "i2", F.col(value).cast("double").alias("density"))
    for axis in ("i0", "i1", "i2"):
        # a voxel at position p gets w(off) from position clamp(p + off): scatter is the mirror image, edges repeat
        spread_ = out.select("*", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("p")).where(F.abs(F.col("p") - F.col(axis)) <= radius)
        t = spread_.select("*", F.explode(taps).alias("t")).where(F.least(F.greatest(F.col("p") + F.col("t.off"), F.lit(0)), F.lit(cells - 1)) == F.col(axis))
        keys = [F.col("p").alias(axis) if a == axis else F.col(a) for a in ("i0", "i1", "i2")]
        out = t.select(*by, *keys, (F.col("density") * F.col("t.w")).alias("density")).groupBy(*by, "i0", "i1", "i2").agg(F.sum("density").alias("density"))
    return out


def shell(grid: DataFrame, by: list[str], quantile: float) -> DataFrame:
    """Voxels at or above the quantile of their key's positive densities, on the surface (a 6-neighbour lacks)."""
    pos = grid.where("density > 0")
    level = pos.groupBy(*by).agg(F.percentile("density", F.lit(quantile)).alias("level"))
    inside = pos.join(level, by).where(F.col("density") >= F.col("level") - 1e-12)
    moves = F.array(*[F.struct(*[F.lit(s if k == a else 0).alias(f"s{k}") for k in range(3)]) for a in range(3) for s in (-1, 1)])
    around = inside.select(*by, F.explode(moves).alias("s"), "i0", "i1", "i2").select(*by, *[(F.col(f"i{k}") + F.col(f"s.s{k}")).alias(f"i{k}") for k in range(3)])
    counts = around.groupBy(*by, "i0", "i1", "i2").agg(F.count(F.lit(1)).alias("beside"))
    return inside.join(counts, [*by, "i0", "i1", "i2"], "left").where("coalesce(beside, 0) < 6").select(*by, "i0", "i1", "i2", "density")


def auto_bins(df: DataFrame, by: list[str], column: str, pad: float = 0.08) -> DataFrame:
    """Histogram over the padded range of the whole column; bins = clamp(ceil(sqrt n), 6, 24), 5 if n <= 1."""
    r = df.agg((F.min(column) - (F.max(column) - F.min(column)) * pad).alias("lo"), (F.max(column) + (F.max(column) - F.min(column)) * pad).alias("hi"))
    per = df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count(column).alias("n"))
    bins = F.when(F.col("n") <= 1, 5).otherwise(F.least(F.greatest(F.ceil(F.sqrt("n")), F.lit(6)), F.lit(24))).cast("int")
    per = per.withColumn("bins", bins).drop("n")
    j = df.where(F.col(column).isNotNull()).join(per, by).crossJoin(F.broadcast(r))  # r is one row
    at = F.least(F.floor((F.col(column) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * F.col("bins")), F.col("bins") - 1)
    at = F.coalesce(at, F.lit(0)).cast("int")
    return j.groupBy(*by, "bins", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def normalise_table(df: DataFrame, aliases: dict[str, list[str]], required: list[str]) -> DataFrame:
    """Each target is the first non-null of its aliases; rows lacking a finite required value say so."""
    present = {t: [F.col(a) for a in names if a in df.columns] for t, names in aliases.items()}
    out = df.select(*[(F.coalesce(*c) if c else F.lit(None).cast("string")).alias(t) for t, c in present.items()], *required)
    return out.withColumn("reason", F.concat_ws(";", *[F.when(finite(F.col(r)).isNull(), F.lit(f"{r}_nonfinite")) for r in required])).withColumn("ok", F.col("reason") == "")


def flatten_stats(long: DataFrame, by: list[str], names: list[str], least: int, most_nan: float, prefix: str) -> DataFrame:
    """(family, metric, stat, value, n, nan_frac) to one wide row per key; families under the gates are null."""
    gate = long.groupBy(*by, "family").agg(F.min("n").alias("n"), F.max("nan_frac").alias("nan_frac"))
    ok = gate.where((F.col("n") >= least) & (F.col("nan_frac") <= most_nan)).select(*by, "family")
    good = long.join(ok, [*by, "family"], "left_semi").withColumn("name", F.concat_ws("_", F.lit(prefix), "family", "metric", "stat"))
    wide = good.groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    return long.select(*by).distinct().join(wide, by, "left")


def event_rate(counts: DataFrame, by: list[str], start: str, end: str, n: str) -> DataFrame:
    """Duration (last end - first start), events inside, rate in Hz, median and mean count."""
    out = counts.groupBy(*by).agg((F.max(end) - F.min(start)).alias("duration"), F.sum(n).alias("n_events"), F.median(n).alias("median_count"), F.avg(n).alias("mean_count"))
    return out.withColumn("rate_hz", F.when(F.col("duration") > 0, F.col("n_events") / F.col("duration")))


def interval_features(samples: DataFrame, by: list[str], least_seconds: float, rate: float) -> DataFrame:
    """Level, slope (four points or more), mean absolute phasic part, peaks per second and their mean height.

    ``samples``: keys, time, tonic, phasic, peak (0/1). Keys with too few samples get nulls and failed = true.
    """
    n = F.count("tonic")
    out = samples.groupBy(*by).agg(
        n.alias("n"), F.avg("tonic").alias("level"), F.when(n >= 4, F.regr_slope("tonic", "time")).alias("slope"), F.avg(F.abs("phasic")).alias("phasic"),
        F.sum("peak").alias("peaks"), F.avg(F.when(F.col("peak") == 1, F.col("phasic"))).alias("height"),
    )
    out = out.withColumn("failed", F.col("n") < least_seconds * rate)
    ok = lambda c: F.when(~F.col("failed"), c)
    out = out.withColumns({c: ok(F.col(c)) for c in ("level", "slope", "phasic", "peaks", "height")})
    return out.withColumn("peak_rate", F.col("peaks") / (F.col("n") / rate)).withColumn("arousal", F.col("peak_rate") + F.abs("slope"))
