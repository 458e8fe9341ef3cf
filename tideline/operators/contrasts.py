"""Contrasts of conditions and groups over the long metric table, negative controls and event-locked deltas."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.resample import draws, item_key
from tideline.functions.scalars import sum_in_order
from tideline.operators import stats
from tideline.operators.quantiles import quantiles
from tideline.operators.tiles import batches_of
from tideline.sources.scan import written


def collapse(metrics: DataFrame, contrasts: DataFrame, keys: list[str], pair: list[str], order: str | None = None) -> DataFrame:
    """Left and right means per contrast, key and pairing unit, for all contrasts in one job.

    ``contrasts``: contrast_name, left, right (condition values); a small configuration table, broadcast by its size.
    ``ok`` rows count for qc and values; all rows count for totals. Conditions are aggregated first, once for all
    contrasts. With ``order``, values are summed in it, so that equal means are equal wherever the rows lie.
    """
    sides = contrasts.select("contrast_name", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left").alias("condition")), F.struct(F.lit("right").alias("side"), F.col("right").alias("condition")))).alias("c")).select("contrast_name", "c.side", "c.condition")
    ok = F.when(F.col("ok"), F.col("value"))
    total = F.sum(ok.cast("double")) if order is None else sum_in_order(ok, F.col(order))
    each = metrics.groupBy(*keys, *pair, "condition").agg(F.count(F.lit(1)).alias("__total"), F.count(F.when(F.col("ok"), 1)).alias("__qc"), F.count(ok).alias("__n"), total.alias("__sum"))
    rows, aggs = each.join(sides, "condition"), []
    for s in ("left", "right"):
        of = lambda name: F.sum(F.when(F.col("side") == s, F.col(name)))  # noqa: E731, B023
        aggs += [F.coalesce(of(f"__{n}"), F.lit(0)).alias(f"{s}_{n}") for n in ("total", "qc")] + [(of("__sum") / F.nullif(of("__n"), F.lit(0))).alias(s)]
    return rows.groupBy("contrast_name", *keys, *pair).agg(*aggs)


def paired_contrast(collapsed: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Counts, qc rates, means, medians, right - left, dz; a reason where there are too few pairs."""
    d = collapsed.withColumn("diff", F.col("right") - F.col("left"))
    pair = F.col("diff").isNotNull()
    out = d.groupBy("contrast_name", *keys).agg(
        *[F.sum(f"{s}_total").alias(f"{s}_n_total") for s in ("left", "right")], *[F.sum(f"{s}_qc").alias(f"{s}_n_qc") for s in ("left", "right")],
        F.count("diff").alias("n_pairs"), *[F.avg(F.when(pair, F.col(s))).alias(f"{s}_mean") for s in ("left", "right")], *[F.median(F.when(pair, F.col(s))).alias(f"{s}_median") for s in ("left", "right")],
        F.avg("diff").alias("effect_estimate"), F.stddev_samp("diff").alias("__sd"),
    )
    out = out.withColumns({f"{s}_qc_rate": F.when(F.col(f"{s}_n_total") > 0, F.col(f"{s}_n_qc") / F.col(f"{s}_n_total")) for s in ("left", "right")})
    out = out.withColumn("effect_size", F.when((F.col("n_pairs") >= 2) & (F.col("__sd") > 0), F.col("effect_estimate") / F.col("__sd"))).drop("__sd")
    return out.withColumn("skip_reason", F.when(F.col("n_pairs") == 0, "no pairs").when(F.col("n_pairs") < least, "too few pairs"))


def unpaired_contrast(df: DataFrame, keys: list[str], is_left: Column, value: str = "value", least: int = 2) -> DataFrame:
    """Two groups of any size: n, mean, median (from refined ranges), right - left, Cohen's d with the pooled deviation."""
    v = {"left": F.when(is_left, F.col(value)), "right": F.when(~is_left, F.col(value))}
    aggs = [f(v[s]).alias(f"{s}_{n}") for s in v for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    out = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    middle = quantiles(df, keys, v, {"median": 0.5})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True))
    middle = middle.select(*[F.col(k).alias(f"__{k}") for k in keys], "left_median", "right_median")
    out = out.join(middle if keys else F.broadcast(middle), on, "left").drop(*[f"__{k}" for k in keys])  # without keys, one row each
    n1, n2 = F.col("left_n"), F.col("right_n")
    pooled = F.sqrt(((n1 - 1) * F.col("left_var") + (n2 - 1) * F.col("right_var")) / F.nullif(n1 + n2 - 2, F.lit(0)))
    out = out.withColumn("effect_estimate", F.col("right_mean") - F.col("left_mean")).withColumn("effect_size", F.when((n1 >= least) & (n2 >= least) & (pooled > 0), F.col("effect_estimate") / pooled))
    return out.withColumn("skip_reason", F.when((n1 < least) | (n2 < least), "too few rows")).drop("left_var", "right_var")


def drive(metrics: DataFrame, contrasts: DataFrame, keys: list[str], pair: str, permutations: int = 5000, replicates: int = 2000, order: str | None = None) -> DataFrame:
    """Every contrast and key at once: T1, exact or random sign-flip p by the number of pairs, bootstrap interval, q."""
    c = written(collapse(metrics, contrasts, keys, [pair], order))  # read by every test
    by = ["contrast_name", *keys]
    diffs = c.withColumn("diff", F.col("right") - F.col("left")).where("diff is not null").select(*by, pair, "diff")
    n = diffs.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    few = diffs.join(n.where("__n <= 16"), by, "left_semi")
    many = diffs.join(n.where("__n > 16"), by, "left_semi")
    p = stats.exact_paired_p(few, by, "diff", pair).select(*by, "p").unionByName(stats.paired_permutation_p(many, by, "diff", pair, permutations).select(*by, "p"))
    ci = stats.bootstrap_ci(diffs, by, "diff", pair, replicates).select(*by, "ci_low", "ci_high")
    out = paired_contrast(c, keys).join(p, by, "left").join(ci, by, "left").withColumn("p", F.when(F.col("skip_reason").isNull(), F.col("p")))
    return stats.benjamini_hochberg(out, ["contrast_name"], "p", keys[0] if keys else "contrast_name")


def sign_control(diffs: DataFrame, by: list[str], item: str, n: int, seed: int = 0) -> DataFrame:
    """Dz of randomly signed differences: null quantiles and how often they reach the observed dz.

    Flips leave squares as they are, so a replicate's dz follows from its sum alone.
    """
    o = diffs.groupBy(*by).agg(F.sum("diff").alias("__sum"), F.sum(F.col("diff") ** 2).alias("__squares"), F.count("diff").alias("__n"))
    s = stats.flipped_sums(diffs, by, "diff", item, n, seed).join(o, by)

    def dz(total: Column) -> Column:
        m = F.col("__n")
        spread = F.sqrt(F.greatest((F.col("__squares") - total * total / m) / F.nullif(m - 1, F.lit(0)), F.lit(0.0)))
        return F.coalesce(total / m / F.nullif(spread, F.lit(0.0)), F.lit(0.0))

    return _null_summary(s.select(*by, "rep", dz(F.col("s")).alias("s"), dz(F.col("__sum")).alias("o")), by)


def _stage_gaps(n: int):
    """Of each batch of subjects: sums, squares and counts of first minus third stage in the order of draws, by group and replicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, values, keys = np.asarray(batch.column("of")), batch.column("vs"), batch.column("keys")
            groups, first, at = np.unique(of, return_index=True, return_inverse=True)
            sums = np.zeros((len(groups), 3, n))
            for row in range(len(batch)):
                v, key = np.asarray(values[row].values), np.asarray(keys[row].values)
                order = np.argsort(draws(key, np.arange(n)), axis=1, kind="stable")
                gap = v[order[:, 0]] - v[order[:, 2]]
                sums[at[row]] += [np.nan_to_num(gap), np.nan_to_num(gap * gap), np.isfinite(gap)]
            held = [pa.ListArray.from_arrays(pa.array(np.arange(len(groups) + 1) * n, pa.int32()), pa.array(sums[:, c].ravel())) for c in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("g").take(pa.array(first)), *held], ["g", "s", "q", "m"])

    return run


def stage_control(long: DataFrame, by: list[str], subject: str, stage: str, value: str, n: int, seed: int = 0) -> DataFrame:
    """Stages of each subject in the order of draws per replicate; dz of the first minus the third.

    A subject is one row with an array of its stages; replicates are summed batch by batch. Subjects with fewer than
    three stages have no gap.
    """
    item = F.concat_ws(":", F.col(subject).cast("string"), F.col(stage).cast("string"))
    stages = F.sort_array(F.collect_list(F.struct(F.col(stage).alias("s"), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("v"), item_key(seed, item, "stage").alias("k"))))
    packed = long.groupBy(*by, subject).agg(stages.alias("x")).where(F.size("x") >= 3).select(F.struct(*by).alias("g"), F.transform("x", lambda r: r["v"]).alias("vs"), F.transform("x", lambda r: r["k"]).alias("keys"))
    packed = written(packed.withColumn("of", F.xxhash64("g")))
    dz = lambda s, q, m: F.coalesce(s / m / F.nullif(F.sqrt(F.greatest((q - s * s / m) / F.nullif(m - 1, F.lit(0.0)), F.lit(0.0))), F.lit(0.0)), F.lit(0.0))
    with batches_of(long.sparkSession, 1000):
        parts = written(packed.mapInArrow(_stage_gaps(n), f"g {packed.schema['g'].dataType.simpleString()}, s array<double>, q array<double>, m array<double>"))
    each = parts.select("g", F.posexplode(F.arrays_zip("s", "q", "m")).alias("rep", "z")).groupBy("g", "rep").agg(*[F.sum(f"z.{c}").alias(c) for c in "sqm"])
    gap = F.when(~F.isnan(F.get("vs", 0) - F.get("vs", 2)), F.get("vs", 0) - F.get("vs", 2))
    o = packed.select("g", gap.alias("gap")).groupBy("g").agg(F.sum("gap").alias("os"), F.sum(F.col("gap") ** 2).alias("oq"), F.count("gap").cast("double").alias("om"))
    null = each.join(o, "g").select(*[F.col(f"g.{c}").alias(c) for c in by], dz(F.col("s"), F.col("q"), F.nullif("m", F.lit(0.0))).alias("s"), dz(F.col("os"), F.col("oq"), F.nullif("om", F.lit(0.0))).alias("o"))
    return _null_summary(null, by)


def _null_summary(null: DataFrame, by: list[str]) -> DataFrame:
    q = lambda x: F.percentile("s", F.lit(x))
    return null.groupBy(*by).agg(F.max("o").alias("observed_dz"), q(0.025).alias("null_low"), q(0.5).alias("null_median"), q(0.975).alias("null_high"), F.avg((F.abs("s") >= F.abs("o") - 1e-9).cast("double")).alias("exceedance"))


def bin_descriptives(df: DataFrame, by: list[str], event: str, value: str) -> DataFrame:
    """Windows, distinct events, finite count, mean, median and std (sample) by key."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_windows"), F.count_distinct(event).alias("n_events"), F.count(value).alias("n_finite"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"))


def baseline_deltas(df: DataFrame, by: list[str], bins: str, baseline: str, metrics: list[str]) -> DataFrame:
    """Target bin minus baseline bin of each metric, for keys that have a baseline."""
    long = df.unpivot([*by, bins], metrics, "metric", "value")
    base = long.where(F.col(bins) == baseline).select(*[F.col(b).alias(f"__{b}") for b in by], F.col("metric").alias("__metric"), F.col("value").alias("baseline"))
    on = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by], F.col("metric") == F.col("__metric"))
    return long.where(F.col(bins) != baseline).join(base, on).select(*by, bins, "metric", (F.col("value") - F.col("baseline")).alias("delta"))


def pairwise_tests(df: DataFrame, by: list[str], subject: str, condition: str, value: str) -> DataFrame:
    """Signed-rank tests of all condition pairs on common subjects, with dz (population) and q."""
    a = df.select(*by, subject, F.col(condition).alias("a"), F.col(value).alias("va"))
    b = df.select(*by, subject, F.col(condition).alias("b"), F.col(value).alias("vb"))
    d = a.join(b, [*by, subject]).where("a < b").withColumn("diff", F.col("vb") - F.col("va"))
    keys = [*by, "a", "b"]
    size = d.groupBy(*keys).agg(F.count("diff").alias("n_pairs"), (F.avg("diff") / (F.stddev_pop("diff") + 1e-12)).alias("dz"))
    out = size.join(stats.wilcoxon(d, keys).select(*keys, "w", "p"), keys, "left").withColumn("id", F.concat_ws(":", "a", "b"))
    return stats.benjamini_hochberg(out, by, "p", "id", null_as_one=True).drop("id")


def correlation_grid(left: DataFrame, right: DataFrame, on: list[str], lefts: list[str], rights: list[str], by: list[str]) -> DataFrame:
    """Rank correlation of every left column with every right one by key, with p and q."""
    l = left.unpivot([*on], lefts, "x", "vx")
    r = right.unpivot([*on], rights, "y", "vy")
    out = stats.spearman(l.join(r, on), [*by, "x", "y"], "vx", "vy", 5, p=True, large=True).withColumn("id", F.concat_ws(":", *by, "x", "y"))
    return stats.benjamini_hochberg(out, [], "p", "id").drop("id")


def within_session_correlation(df: DataFrame, session: str, by: list[str], x: str, y: str, least: int = 10) -> DataFrame:
    """Rank correlation in each session, then counts of signs, median r and a signed-rank test of r by key."""
    r = stats.spearman(df, [*by, session], x, y, least).where("r is not null")
    head = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sessions"), F.sum((F.round("r", 9) > 0).cast("long")).alias("n_positive"), F.median("r").alias("median_r"))
    return head.join(stats.wilcoxon(r.withColumnRenamed("r", "diff"), by).select(*by, "w", "p"), by, "left")


def confound_table(tables: dict[str, tuple[DataFrame, str]], metric: tuple[DataFrame, str], subject: str, condition: str, sides: tuple[str, str]) -> DataFrame:
    """Rank correlation of each confound's difference with the metric's difference, q over all confounds."""
    def gap(df, value, name):
        m = [F.median(F.when(F.col(condition) == s, F.col(value))) for s in sides]
        return df.groupBy(subject).agg((m[1] - m[0]).alias(name))

    main, out = gap(*metric, "metric_gap"), None
    for name, (df, value) in tables.items():
        r = stats.spearman(gap(df, value, "confound_gap").join(main, subject).withColumn("confound", F.lit(name)), ["confound"], "confound_gap", "metric_gap", 5, p=True, large=True)
        out = r if out is None else out.unionByName(r)
    return stats.benjamini_hochberg(out, [], "p", "confound")
