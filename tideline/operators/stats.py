"""Ranks, correlations, tests, multiple testing and resampling over collapsed tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions.distributions import chi2_p, t_p, wilcoxon_p
from tideline.functions.resample import draw, item_key
from tideline.functions.scalars import rounded
from tideline.operators.quantiles import quantiles
from tideline.operators.ranges import running
from tideline.operators.resampling import HELD, drawn_moments, flipped_medians, flipped_sums, gathered, left_sums, picked, replicated
from tideline.sources.scan import written


def _same(by: list[str], prefix: str) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in by]


def ordered(df: DataFrame, by: list[str], order: list[str], value: Column | None = None) -> DataFrame:
    """Adds __part (a range of the order) and __before: the sum of ``value`` (rows) over earlier rows of the key.

    For keys with very many rows: rows are range-partitioned by key and order and written down with their range; each
    range is summed by itself, and only one row for each range and key is summed across ranges.
    """
    value = F.lit(1) if value is None else value
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()))
    held = ranged.groupBy(*by, "__part").agg(F.sum(value).alias("__held"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offset = held.select(*[F.col(c).alias(f"__o_{c}") for c in by], F.col("__part").alias("__o_part"), F.coalesce(F.sum("__held").over(earlier), F.lit(0)).alias("__offset"))
    inside = F.sum(value).over(Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = ranged.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(offset, [F.col("__part") == F.col("__o_part"), *_same(by, "__o_")])
    return out.withColumn("__before", F.col("__inside") + F.col("__offset")).drop("__inside", "__offset", "__o_part", *[f"__o_{c}" for c in by])


def average_ranks(df: DataFrame, by: list[str], values: dict[str, str]) -> DataFrame:
    """Average ranks (value column -> new column) within keys of any size: from counts of equal values, in ranges."""
    for value, name in values.items():
        counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
        ranks = ordered(counts, by, [value], F.col("__n")).select(*[F.col(c).alias(f"__r_{c}") for c in by], F.col(value).alias("__r_value"), (F.col("__before") + (F.col("__n") + 1) / 2.0).alias(name))
        df = df.join(ranks, [F.col(value).eqNullSafe(F.col("__r_value")), *_same(by, "__r_")]).drop("__r_value", *[f"__r_{c}" for c in by])
    return df


def average_rank(by: list[str], value: str) -> Column:
    """Average rank of ties within a key."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def correlation(x: str, y: str) -> Column:
    """Correlation of two columns, null where one doesn't vary."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def spearman(df: DataFrame, by: list[str], x: str, y: str, least: int = 5, p: bool = False, large: bool = False) -> DataFrame:
    """Rank correlation of complete pairs by key, null under ``least`` pairs; optionally its t-test p.

    ``large``: keys may have very many rows (ranks by ranges, see ``ordered``).
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(pairs.select(*by, x, y), by, {x: "rx", y: "ry"}) if large else pairs.select(*by, average_rank(by, x).alias("rx"), average_rank(by, y).alias("ry"))
    n = F.count(F.lit(1))
    out = ranked.groupBy(*by).agg(n.alias("n"), F.when((n >= least) & (F.stddev_pop("rx") > 0) & (F.stddev_pop("ry") > 0), correlation("rx", "ry")).alias("r"))
    return out if not p else with_r_p(out, F.col("n") - 2)


def with_r_p(df: DataFrame, dof: Column) -> DataFrame:
    t = F.col("r") * F.sqrt(dof / F.greatest(1 - F.col("r") ** 2, F.lit(1e-15)))
    return df.withColumn("p", t_p(t, dof))


def partial_spearman(df: DataFrame, by: list[str], x: str, y: str, z: str, least: int = 6) -> DataFrame:
    """Rank correlation of x and y given z."""
    full = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (x, y, z)]))
    ranked = full.select(*by, *[average_rank(by, c).alias(n) for c, n in ((x, "rx"), (y, "ry"), (z, "rz"))])
    r = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation("rx", "ry").alias("xy"), correlation("rx", "rz").alias("xz"), correlation("ry", "rz").alias("yz"))
    part = (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt(F.greatest((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2), F.lit(1e-15)))
    return with_r_p(r.select(*by, "n", F.when(F.col("n") >= least, part).alias("r")), F.col("n") - 3)


def wilcoxon(df: DataFrame, by: list[str], diff: str = "diff", least: int = 5, p: bool = True, large: bool = False) -> DataFrame:
    """Signed-rank test of differences by key: n without zeros, w = the smaller rank sum, p.

    Ranks follow from counts of equal sizes; ``large``: keys may have very many sizes (see ``ordered``).
    """
    d = df.where(F.col(diff).isNotNull() & (F.col(diff) != 0))
    sizes = d.groupBy(*by, rounded(F.abs(F.col(diff)), 9).alias("__a")).agg(F.count(F.lit(1)).alias("__n"), F.count(F.when(F.col(diff) > 0, 1)).alias("__up"))
    if large:
        ranked = ordered(sizes, by, ["__a"], F.col("__n"))
    else:
        earlier = Window.partitionBy(*by).orderBy("__a").rowsBetween(Window.unboundedPreceding, -1)
        ranked = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    rank = F.col("__before") + (F.col("__n") + 1) / 2.0
    n = F.col("__n").cast("double")
    out = ranked.groupBy(*by).agg(F.sum("__n").alias("n"), F.sum(F.col("__up") * rank).alias("plus"), F.sum((F.col("__n") - F.col("__up")) * rank).alias("minus"), F.sum(n * (n * n - 1)).alias("ties"))
    out = out.withColumn("w", F.when(F.col("n") >= least, F.least("plus", "minus")))
    return out.withColumn("p", wilcoxon_p(F.col("w"), F.col("n"), F.col("ties"))) if p else out


def friedman(df: DataFrame, by: list[str], subject: str, condition: str, value: str, k: int, p: bool = True) -> DataFrame:
    """Chi-square over subjects that have all ``k`` conditions, corrected for ties."""
    full = df.where(F.col(value).isNotNull())
    whole = full.groupBy(*by, subject).agg(F.count_distinct(condition).alias("__k")).where(F.col("__k") == k)
    ranked = full.join(whole.drop("__k"), [*by, subject], "left_semi").withColumn("__r", average_rank([*by, subject], value)).withColumn("__t", F.count(F.lit(1)).over(Window.partitionBy(*by, subject, value)))
    sums = ranked.groupBy(*by, condition).agg(F.sum("__r").alias("s"), F.count(F.lit(1)).alias("n"), F.sum(F.col("__t").cast("double") ** 2 - 1).alias("ties"))
    n = F.max("n")
    raw = 12.0 / (n * k * (k + 1)) * F.sum(F.col("s") ** 2) - 3 * n * (k + 1)
    out = sums.groupBy(*by).agg(n.alias("n"), (raw / F.nullif(1 - F.sum("ties") / (n * (k**3 - k)), F.lit(0.0))).alias("chi2"))
    return out.withColumn("p", chi2_p(F.col("chi2"), k - 1)) if p else out


def one_sample(df: DataFrame, by: list[str], value: str, least: int = 3, p: bool = True) -> DataFrame:
    """N, mean, sd, sem, dz and t of a mean against zero."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    ok = (F.col("n") >= least) & (F.col("sd") > 0)
    out = out.withColumn("sem", F.col("sd") / F.sqrt("n")).withColumn("dz", F.when(ok, F.col("mean") / F.col("sd"))).withColumn("t", F.when(ok, F.col("mean") / F.col("sem")))
    return out.withColumn("p", t_p(F.col("t"), F.col("n") - 1)) if p else out


def fdr_of_rows(df: DataFrame, by: list[str], p: str = "p", tie: str = "id", null_as_one: bool = False) -> DataFrame:
    """T7 for groups of any size: ranks and running minima by ranges of p (see ``ordered``)."""
    d = df.withColumn("__p", F.coalesce(F.col(p), F.lit(1.0)) if null_as_one else F.col(p))
    n = d.groupBy(*by).agg(F.count("__p").alias("__m")).select(*[F.col(c).alias(f"__m_{c}") for c in by], "__m")
    r = ordered(d.where("__p is not null"), by, ["__p", tie]).join(F.broadcast(n) if not by else n, _same(by, "__m_") or F.lit(True)).withColumn("__q", F.col("__p") * F.col("__m") / (F.col("__before") + 1))
    least = r.groupBy(*by, "__part").agg(F.min("__q").alias("__least"))
    later = Window.partitionBy(*by).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    after = least.select(*[F.col(c).alias(f"__a_{c}") for c in by], F.col("__part").alias("__a_part"), F.min("__least").over(later).alias("__after"))
    inside = F.min("__q").over(Window.partitionBy(*by, "__part").orderBy(F.desc("__before")).rowsBetween(Window.unboundedPreceding, 0))
    q = r.withColumn("__inside", inside).join(after, [F.col("__part") == F.col("__a_part"), *_same(by, "__a_")]).withColumn("q", F.least("__inside", "__after", F.lit(1.0)))
    return q.select(*df.columns, "q").unionByName(d.where("__p is null").select(*df.columns, F.lit(None).cast("double").alias("q")))


def benjamini_hochberg(df: DataFrame, by: list[str], p: str = "p", tie: str = "id", null_as_one: bool = False) -> DataFrame:
    """Q values by group; null p is left out (or counted as 1)."""
    v = F.coalesce(F.col(p), F.lit(1.0)) if null_as_one else F.col(p)
    d = df.withColumn("__p", v)
    w = Window.partitionBy(*by, F.col("__p").isNull())
    rank = F.row_number().over(w.orderBy("__p", tie))
    d = d.withColumn("__q", F.when(F.col("__p").isNotNull(), F.col("__p") * F.count("__p").over(w) / rank)).withColumn("__n", rank)
    q = F.min("__q").over(w.orderBy(F.desc("__n")).rowsBetween(Window.unboundedPreceding, 0))  # a running minimum, from the largest p on
    return d.withColumn("q", F.least(q, F.lit(1.0))).withColumn("q", F.when(F.col("__p").isNotNull(), F.col("q"))).drop("__p", "__q", "__n")


def replicates(df: DataFrame, n: int) -> DataFrame:
    """Each row once per replicate (column rep). For collapsed tables only: rows grow n-fold."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def exact_paired_p(df: DataFrame, by: list[str], diff: str, item: str, most: int = 16) -> DataFrame:
    """T4: all sign vectors of up to ``most`` pairs, p = (hits + 1) / (2^n + 1)."""
    w = Window.partitionBy(*by)
    d = df.withColumn("__i", F.row_number().over(w.orderBy(item)) - 1).withColumn("__n", F.count(F.lit(1)).over(w)).where(F.col("__n") <= most)
    signs = d.withColumn("rep", F.explode(F.expr("sequence(0L, shiftleft(1L, __n) - 1)")))
    s = F.when(F.expr("shiftright(rep, __i) % 2") == 1, -F.col(diff)).otherwise(F.col(diff))
    sums = signs.groupBy(*by, "rep").agg(F.sum(s).alias("s"), F.sum(diff).alias("o"), F.max("__n").alias("n"))
    hits = F.sum((F.abs("s") >= F.abs("o") - 1e-9).cast("long"))
    return sums.groupBy(*by).agg(F.max("n").alias("n"), ((hits + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def paired_permutation_p(df: DataFrame, by: list[str], diff: str, item: str, n: int, seed: int = 0) -> DataFrame:
    """T4: random sign flips of the pairs' differences, p = (hits + 1) / (n + 1). Groups may have any size."""
    s = flipped_sums(df, by, diff, item, n, seed)
    o = df.groupBy(*by).agg(F.sum(diff).alias("__o"), F.count(diff).alias("__n")).select(*[F.col(c).alias(f"__{c}") for c in by], "__o", "__n")
    hits = F.sum((F.abs(F.col("s") / F.col("__n")) >= F.abs(F.col("__o") / F.col("__n")) - 1e-9).cast("long"))
    return s.join(o, _same(by, "__")).groupBy(*by).agg(((hits + 1) / (n + 1)).alias("p"))


def label_permutation_p(df: DataFrame, by: list[str], value: str, is_left: str, item: str, n: int, seed: int = 0) -> DataFrame:
    """T5: shuffled labels: the n_left rows with the smallest draws are the left side. p = (hits + 1) / (n + 1)."""

    def kernel(x: dict, h: np.ndarray) -> np.ndarray:
        v, left = x["v"], int(x["lf"].sum())
        order = np.argsort(h, axis=1, kind="stable")[:, :left]  # ties by item
        low = v[order].sum(1)
        return (v.sum() - low) / max(len(v) - left, 1) - low / max(left, 1) if 0 < left < len(v) else np.full(len(h), np.nan)

    def large(rows: DataFrame) -> DataFrame:
        every = rows.groupBy(*by).agg(F.sum("v").alias("__t"), F.count(F.lit(1)).alias("__n"), F.sum("lf").alias("__l")).select(*[F.col(c).alias(f"__{c}") for c in by], "__t", "__n", "__l")
        low = left_sums(rows, by, item, n, seed, "label").join(every, _same(by, "__"))
        return low.select(*by, "rep", ((F.col("__t") - F.col("low")) / (F.col("__n") - F.col("__l")) - F.col("low") / F.col("__l")).alias("s"))

    s = replicated(df.where(F.col(value).isNotNull()), by, {"v": F.col(value), "lf": F.col(is_left).cast("int")}, item, n, kernel, large, seed, "label")
    side = lambda left: F.avg(F.when(left, F.col(value)))
    o = df.groupBy(*by).agg((side(~F.col(is_left)) - side(F.col(is_left))).alias("__o")).select(*[F.col(c).alias(f"__{c}") for c in by], "__o")
    return s.join(o, _same(by, "__")).groupBy(*by).agg(((F.sum((F.abs("s") >= F.abs("__o") - 1e-9).cast("long")) + 1) / (n + 1)).alias("p"))


def resampled(df: DataFrame, by: list[str], item: str, n: int, seed: int = 0, salt: str = "boot") -> DataFrame:
    """T6 for groups of any size, as rows: for every replicate and draw, the row at draw * size / 2^32."""
    d = ordered(df, by, [item]).withColumn("__i", F.col("__before").cast("bigint"))
    size = d.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    rows = replicates(d.select(*by, item_key(seed, item, salt).alias("__key")).join(size, by), n)
    rows = rows.select(*by, "rep", F.shiftrightunsigned(draw(F.col("__key"), F.col("rep")) * F.col("__n"), 32).alias("__i"))
    return rows.join(d.drop("__part", "__before"), [*by, "__i"])


def chosen(h: np.ndarray) -> np.ndarray:
    """Row numbers that a matrix of draws picks: one for each draw."""
    return picked(h, h.shape[1])


def _interval(s: DataFrame, by: list[str]) -> DataFrame:
    out = s.groupBy(*by).agg(F.percentile("s", F.lit(0.025)).alias("ci_low"), F.percentile("s", F.lit(0.975)).alias("ci_high"), F.stddev_samp("s").alias("se"))
    return out.withColumn("excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def bootstrap_ci(df: DataFrame, by: list[str], value: str, item: str, n: int, seed: int = 0) -> DataFrame:
    """2.5 and 97.5 % points and standard error of the mean over bootstrap samples."""
    mean = lambda x, h: x["v"][chosen(h)].mean(1)
    large = lambda rows: drawn_moments(rows, by, item, n, seed, squares=False).select(*by, "rep", F.col("mean").alias("s"))
    return _interval(replicated(df.where(F.col(value).isNotNull()), by, {"v": F.col(value)}, item, n, mean, large, seed), by)


def bootstrap_dz(df: DataFrame, by: list[str], value: str, item: str, n: int, seed: int = 0) -> DataFrame:
    """The same of dz (mean over sample deviation)."""
    dz = lambda x, h: (lambda v: v.mean(1) / np.where(v.std(1, ddof=1) > 0, v.std(1, ddof=1), np.nan))(x["v"][chosen(h)])
    large = lambda rows: drawn_moments(rows, by, item, n, seed).select(*by, "rep", (F.col("mean") / F.nullif(F.sqrt("var"), F.lit(0.0))).alias("s"))
    return _interval(replicated(df.where(F.col(value).isNotNull()), by, {"v": F.col(value)}, item, n, dz, large, seed), by)


def _classes(v: np.ndarray) -> np.ndarray:
    """Numbers of equal values in their order."""
    return np.unique(v, return_inverse=True)[1]


def _mid_ranks(of: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Average rank, less the mean rank, of each value in a sample that holds it so many times."""
    n = np.bincount(of, counts)
    return (np.cumsum(n) - n / 2 - counts.sum() / 2)[of]


def bootstrap_spearman(df: DataFrame, by: list[str], x: str, y: str, item: str, n: int, seed: int = 0, least: int = 5) -> DataFrame:
    """2.5 and 97.5 % points and standard error of the rank correlation over bootstrap samples of complete pairs.

    A sample is how often it holds each row, so its ranks are running sums over values sorted once, not once a replicate.
    """

    def kernel(c: dict, h: np.ndarray) -> np.ndarray:
        if h.shape[1] < least:
            return np.full(len(h), np.nan)
        if "xs" not in c:
            c["xs"], c["ys"] = _classes(c["x"]), _classes(c["y"])
        out = np.full(len(h), np.nan)
        for k, at in enumerate(chosen(h)):
            counts = np.bincount(at, minlength=h.shape[1])
            a, b = _mid_ranks(c["xs"], counts), _mid_ranks(c["ys"], counts)
            size = np.sqrt((counts * a * a).sum() * (counts * b * b).sum())
            if size > 0:
                out[k] = (counts * a * b).sum() / size
        return out

    def large(rows: DataFrame) -> DataFrame:
        size = written(rows.groupBy(*by).agg((F.count(F.lit(1)) > HELD).alias("__beyond")).select(*[F.col(c).alias(f"__{c}") for c in by], "__beyond"))
        part = lambda beyond: rows.join(size.where(F.col("__beyond") == beyond), _same(by, "__"), "left_semi")
        out = gathered(part(False), by, ["x", "y"], item, n, kernel, seed)
        if size.where("__beyond").isEmpty():
            return out
        exploded = spearman(resampled(part(True), by, item, n, seed), [*by, "rep"], "x", "y", least, large=True)
        return out.unionByName(exploded.select(*by, F.col("rep").cast("int").alias("rep"), F.col("r").alias("s")))

    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return _interval(replicated(pairs, by, {"x": F.col(x), "y": F.col(y)}, item, n, kernel, large, seed), by)


def median_sign_p(df: DataFrame, by: list[str], diff: str, item: str, n: int, seed: int = 0) -> DataFrame:
    """Share of sign-flipped medians at least as far from zero as the observed one."""
    df = written(df.select(*by, item, diff))  # read twice
    median = lambda x, h: np.median(np.where(h < np.uint32(1 << 31), -x["v"], x["v"]), axis=1)

    large = lambda rows: flipped_medians(rows, by, item, n, seed, "sign")
    s = replicated(df.where(F.col(diff).isNotNull()), by, {"v": F.col(diff)}, item, n, median, large, seed, "sign")
    o = quantiles(df, by, {"o": F.col(diff)}, {"median": 0.5}).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("o_median").alias("__o"))
    return s.join(o, _same(by, "__")).groupBy(*by).agg(F.avg((F.abs("s") >= F.abs("__o") - 1e-9).cast("double")).alias("p"))


def _beyond(df: DataFrame, by: list[str], order: str, sums: dict[str, Column]) -> DataFrame:
    """One row for each value of ``order`` in a key: each sum over its rows (name) and over rows beyond it (name_above)."""
    own = df.groupBy(*by, order).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    told = running(own, by, [order], {}, {f"{n}_above": ("sum", F.col(n)) for n in sums})
    return told.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(order).alias("__at"), *sums, *[f"{n}_above" for n in sums])


def leave_one_out(df: DataFrame, by: list[str], item: str, x: str, y: str, least: int = 5) -> DataFrame:
    """Rank correlation without each row in turn: mean, least and largest r, whether signs agree, number of fits.

    Without row i, the average rank of a row j falls by 1 if it is above i and by half if it ties with i. So the new
    sums of ranks, squares and products follow from sums over the rows above i, and no row is paired with every
    other; those sums go by ranges, so a key may be a large part of all rows. Rows with a null are left out of all fits,
    and a fit without one is the fit of all.
    """
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    full = written(average_ranks(full, by, {"__x": "__a", "__y": "__b"}))
    a, b, one = F.col("__a"), F.col("__b"), F.lit(1.0)
    on = lambda c: [F.col(c) == F.col("__at"), *_same(by, "__")]
    keyed = lambda d, c, side: d.join(side, on(c)).drop("__at", *[f"__{k}" for k in by])
    d = keyed(full, "__x", _beyond(full, by, "__x", {"xn": one, "xa": a, "xb": b}))
    d = keyed(d, "__y", _beyond(full, by, "__y", {"yn": one, "ya": a, "yb": b}))
    half = lambda value, n: F.col(f"{n}_above") + F.col(n) / 2 - value / 2  # rows above i, and half of its ties without i
    squares = lambda n: F.col(f"{n}_above") + F.col(n) / 4 - 0.25
    sums = full.groupBy(*by).agg(F.sum(a * a).alias("__saa"), F.sum(b * b).alias("__sbb"), F.sum(a * b).alias("__sab"), F.sum(one).alias("__sn"))
    d = d.withColumns({"__ax": half(a, "xa"), "__bx": half(b, "xb"), "__ay": half(a, "ya"), "__by": half(b, "yb"), "__qx": squares("xn"), "__qy": squares("yn")})
    d = d.join(sums.select(*[F.col(c).alias(f"__{c}") for c in by], "__saa", "__sbb", "__sab", "__sn"), _same(by, "__")).drop(*[f"__{k}" for k in by])
    above = _steps_above(full, by)
    d = d.join(above, [F.col("__x") == F.col("__px"), F.col("__y") == F.col("__py"), *_same(by, "__")]).drop("__px", "__py", *[f"__{k}" for k in by])
    m, mean = F.col("__sn") - 1, F.col("__sn") / 2
    vx = F.col("__saa") - a * a - 2 * F.col("__ax") + F.col("__qx") - m * mean * mean
    vy = F.col("__sbb") - b * b - 2 * F.col("__by") + F.col("__qy") - m * mean * mean
    cov = F.col("__sab") - a * b - F.col("__ay") - F.col("__bx") + F.col("__both") - m * mean * mean
    r = d.select(*by, F.when((m >= least) & (vx > 1e-9) & (vy > 1e-9), F.least(F.greatest(cov / F.sqrt(vx * vy), F.lit(-1.0)), F.lit(1.0))).alias("r"))
    lacking = df.where(F.col(x).isNull() | F.col(y).isNull()).select(*by)
    all_ = spearman(df, by, x, y, least, large=True).select(*[F.col(c).alias(f"__{c}") for c in by], "r")
    r = r.unionByName(lacking.join(all_, _same(by, "__"), "left").select(*by, "r"))
    return r.groupBy(*by).agg(F.avg("r").alias("mean_r"), F.min("r").alias("min_r"), F.max("r").alias("max_r"), (F.min(F.signum("r")) == F.max(F.signum("r"))).alias("sign_consistent"), F.count("r").alias("n_fits"))


def _steps_above(full: DataFrame, by: list[str]) -> DataFrame:
    """For each pair of values (__px, __py) of a key (__<by>): steps of both ranks that rows above it in both make (__both).

    Rows above in x and y count 1, those that tie in one of them half, in both a quarter (without the row itself). Values
    above in x are the right halves of the dyadic blocks in whose left half the value's place is: a value is in one
    block for each bit of its place, and counts of a block in the order of y go by ranges, as the top block is half a key.
    """
    points = written(full.groupBy(*by, "__x", "__y").agg(F.count(F.lit(1)).alias("__n")))
    values = ordered(points.select(*by, "__x").distinct(), by, ["__x"]).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__x").alias("__px"), F.col("__before").cast("bigint").alias("__place"))
    at = points.join(values, [F.col("__x") == F.col("__px"), *_same(by, "__")]).drop("__px", *[f"__{k}" for k in by])
    most = values.agg(F.max("__place").alias("m")).first()["m"] or 0
    at = written(at.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(int(most).bit_length())))).withColumn("__half", F.expr("shiftright(__place, __level)")))
    at = at.withColumns({"__right": F.when(F.col("__half") % 2 == 1, F.col("__n")).otherwise(0), "__block": F.floor(F.col("__half") / 2)})
    block = [*by, "__level", "__block"]
    own = at.groupBy(*block, "__y").agg(F.sum("__right").alias("__own"), F.max((F.col("__half") % 2 == 0).cast("int")).alias("__asked"))
    told = running(own, block, ["__y"], {}, {"__above": ("sum", F.col("__own"))}).where("__asked = 1").select(*[F.col(c).alias(f"__{c}") for c in block], F.col("__y").alias("__py"), (F.col("__above") + F.col("__own") / 2.0).alias("__steps"))
    left = at.where(F.col("__half") % 2 == 0).join(told, [F.col("__y") == F.col("__py"), *_same(block, "__")])
    above = left.groupBy(*[F.col(c).alias(f"__{c}") for c in by], F.col("__x").alias("__px"), F.col("__y").alias("__py")).agg(F.sum("__steps").alias("__above_x"))
    # ties in x: half a step in x with the step in y
    ties = running(points, [*by, "__x"], ["__y"], {}, {"__more": ("sum", F.col("__n"))})
    ties = ties.select(*by, "__x", "__y", ((F.col("__more") + F.col("__n") / 2.0 - 0.5) / 2).alias("__tied"))
    out = ties.join(above, [F.col("__x") == F.col("__px"), F.col("__y") == F.col("__py"), *_same(by, "__")], "left")
    return out.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__x").alias("__px"), F.col("__y").alias("__py"), (F.coalesce("__above_x", F.lit(0.0)) + F.col("__tied")).alias("__both"))


def auc(df: DataFrame, by: list[str], score: str, label: str, large: bool = False) -> DataFrame:
    """Area under the curve from average ranks; ``large``: by ranges, for keys with very many rows."""
    keyed, keys = (df, by) if by else (df.withColumn("__one", F.lit(1)), ["__one"])
    r = average_ranks(keyed.select(*keys, score, label), keys, {score: "__r"}) if large else keyed.withColumn("__r", average_rank(keys, score))
    pos, n = F.sum(label), F.count(F.lit(1))
    return r.groupBy(*by).agg(((F.sum(F.when(F.col(label) == 1, F.col("__r"))) - pos * (pos + 1) / 2) / F.nullif(pos * (n - pos), F.lit(0))).alias("auc"), n.alias("n"))
