"""Operators over ordered rows: segments, speed, turning, entropies, autocorrelation, rolling measures, normalising."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators.quantiles import quantiles
from tideline.operators.ranges import running
from tideline.sources.scan import written


def _norm(parts) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))


def segments(df: DataFrame, by: list[str], index: str = "t_idx", large: bool = False) -> DataFrame:
    """Adds segment, the same for consecutive indices. ``large``: keys may have very many rows, which go by ranges."""
    if large:
        return running(df, by, [index], {"__n": ("sum", F.lit(1))}).withColumn("segment", F.col(index) - F.col("__n") - 1).drop("__n")
    return df.withColumn("segment", F.col(index) - F.row_number().over(Window.partitionBy(*by).orderBy(index)))


def _last(df: DataFrame, by: list[str], index: str, columns: dict[str, Column], name: str) -> DataFrame:
    """Adds ``name``: a struct of ``columns`` of the row before, carried from range to range."""
    return running(df, by, [index], {name: ("max", F.struct(F.col(index).alias("__index"), *[c.alias(n) for n, c in columns.items()]))})


def steps(df: DataFrame, by: list[str], axes: list[str], index: str = "t_idx", large: bool = False) -> DataFrame:
    """Adds speed (norm of the step into the row) and angle between that step and the one before, in a segment."""
    d = segments(df, by, index, large)
    if large:
        d = _last(d, by, index, {"segment": F.col("segment"), **{a: F.col(a) for a in axes}}, "__p")
        d = d.withColumns({f"__v_{a}": F.when(F.col("__p.segment") == F.col("segment"), F.col(a) - F.col(f"__p.{a}")) for a in axes})
        d = _last(d, by, index, {"segment": F.col("segment"), **{f"v_{a}": F.col(f"__v_{a}") for a in axes}}, "__q")
        v1, v0 = [F.col(f"__v_{a}") for a in axes], [F.when(F.col("__q.segment") == F.col("segment"), F.col(f"__q.v_{a}")) for a in axes]
    else:
        w = Window.partitionBy(*by, "segment").orderBy(index)
        v1 = [F.col(a) - F.lag(a).over(w) for a in axes]
        v0 = [F.lag(a).over(w) - F.lag(a, 2).over(w) for a in axes]
    dot = reduce(lambda x, y: x + y, [a * b for a, b in zip(v0, v1, strict=True)])
    cos = dot / (_norm(v0) * _norm(v1) + 1e-12)
    d = d.withColumn("speed", _norm(v1)).withColumn("angle", F.acos(F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0))))
    return d.drop("__p", "__q", *[f"__v_{a}" for a in axes])


def path_summary(df: DataFrame, by: list[str], axes: list[str], index: str = "t_idx", large: bool = False) -> DataFrame:
    """path_length, endpoint_dist and traj_efficiency (0 to 1; null without path), summed over segments; means of speed and turning."""
    s = steps(df, by, axes, index, large).groupBy(*by, "segment").agg(
        F.sum("speed").alias("path"), *[(F.max_by(a, index) - F.min_by(a, index)).alias(f"__{a}") for a in axes],
        F.sum("angle").alias("angle_sum"), F.count("angle").alias("angles"), F.count("speed").alias("n_steps"),
    )
    out = s.groupBy(*by).agg(F.sum("path").alias("path_length"), F.sum(_norm([F.col(f"__{a}") for a in axes])).alias("endpoint_dist"), F.count(F.lit(1)).alias("n_segments"), (F.sum("path") / F.sum("n_steps")).alias("speed_mean"), (F.sum("angle_sum") / F.sum("angles")).alias("curvature_mean"))
    return out.withColumn("traj_efficiency", F.when(F.col("path_length") > 0, F.least(F.greatest(F.col("endpoint_dist") / F.col("path_length"), F.lit(0.0)), F.lit(1.0))))


def corner_levels(df: DataFrame, by: list[str], axes: list[str], q: float = 0.6, large: bool = False) -> DataFrame:
    """The quantile of each axis by key."""
    if large:
        return quantiles(df, by, {a: F.col(a) for a in axes}, {"q": q}).select(*by, *[F.col(f"{a}_q").alias(f"__q{a}") for a in axes])
    return df.groupBy(*by).agg(*[F.percentile(a, F.lit(q)).alias(f"__q{a}") for a in axes])


def corner_codes(df: DataFrame, by: list[str], axes: list[str], q: float = 0.6, levels: DataFrame | None = None) -> DataFrame:
    """Adds code, one bit per axis for values at or above the key's quantile (or that in ``levels``)."""
    level = corner_levels(df, by, axes, q) if levels is None else levels
    bits = reduce(lambda x, y: x + y, [(F.col(a) >= F.col(f"__q{a}") - 1e-12).cast("int") * 2**i for i, a in enumerate(axes)])
    return df.join(level, by).withColumn("code", bits).drop(*[f"__q{a}" for a in axes])


def entropy_of(counts: DataFrame, by: list[str], cells: int, n: str = "n") -> DataFrame:
    """Natural-log entropy of counts over ``cells`` cells, p clipped at 1e-12 and made to sum to one again."""
    total = counts.groupBy(*by).agg(F.sum(n).alias("__t"), F.count(F.lit(1)).alias("__k"))
    p = F.greatest(F.col(n) / F.col("__t"), F.lit(1e-12))
    absent = (F.lit(cells) - F.col("__k")) * 1e-12
    sums = counts.join(total, by).groupBy(*by).agg(F.sum(p).alias("__s"), F.sum(p * F.log(p)).alias("__pl"), F.max("__k").alias("__k"))
    z = F.col("__s") + absent
    return sums.select(*by, (-(F.col("__pl") + absent * F.log(F.lit(1e-12))) / z + F.log(z)).alias("entropy"))


def occupancy_entropy(codes: DataFrame, by: list[str], cells: int = 8) -> DataFrame:
    """Entropy of the time in each code."""
    return entropy_of(codes.groupBy(*by, "code").agg(F.count(F.lit(1)).alias("n")), by, cells)


def dwell_entropy(codes: DataFrame, by: list[str], index: str = "t_idx", cells: int = 8, large: bool = False) -> DataFrame:
    """Entropy of summed run lengths by code."""
    if large:
        d = _last(codes, by, index, {"code": F.col("code")}, "__p")
        d = d.withColumn("__new", F.coalesce((F.col("code") != F.col("__p.code")).cast("int"), F.lit(1))).drop("__p")
        runs = running(d, by, [index], {"__run": ("sum", F.col("__new"))}).withColumn("run", F.col("__run") + F.col("__new"))
    else:
        w = Window.partitionBy(*by).orderBy(index)
        runs = codes.withColumn("__new", F.coalesce((F.col("code") != F.lag("code").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("__new").over(w))
    lengths = runs.groupBy(*by, "code", "run").agg(F.count(F.lit(1)).alias("length"))
    return entropy_of(lengths.groupBy(*by, "code").agg(F.sum("length").alias("n")), by, cells)


def transition_entropy(codes: DataFrame, by: list[str], index: str = "t_idx", cells: int = 8, large: bool = False) -> DataFrame:
    """Entropy of consecutive code pairs over cells x cells."""
    if large:
        d = _last(codes, by, index, {"code": F.col("code")}, "__p").where("__p is not null").select(*by, F.col("__p.code").alias("code"), F.col("code").alias("to"))
    else:
        w = Window.partitionBy(*by).orderBy(index)
        d = codes.withColumn("to", F.lead("code").over(w))
    pairs = d.where("to is not null").groupBy(*by, "code", "to").agg(F.count(F.lit(1)).alias("n"))
    return entropy_of(pairs, by, cells * cells)


def autocorrelation_time(df: DataFrame, by: list[str], value: str, dt: float, most_lag: int | None = None, index: str = "t_idx") -> DataFrame:
    """First lag at which the autocorrelation falls under 1/e, times dt; without one, the largest lag looked at.

    Lags go up to ``most_lag`` (round(300 / dt)) and n - 1. Fewer than five values and constant values: null.
    Lagged products are window expressions over blocks of 16, 32, ... lags; only keys that haven't fallen under 1/e go
    on to the next block, and no row is repeated.
    """
    most_lag = max(1, round(300 / dt)) if most_lag is None else most_lag
    g = F.struct(*[F.col(c) for c in by])
    w = Window.partitionBy("g")
    d = df.where(F.col(value).isNotNull()).select(g.alias("g"), F.col(index).alias("i"), F.col(value).cast("double").alias("v"))
    d = written(d.select("g", "i", (F.col("v") - F.avg("v").over(w)).alias("x"), "v"))
    base = written(d.groupBy("g").agg(F.sum(F.col("x") ** 2).alias("power"), F.count(F.lit(1)).alias("n"), (F.max("v") > F.min("v")).alias("varied")))
    open_, crossed, lag, width = base.where("n >= 5 and varied"), [], 1, 16
    while lag <= most_lag:
        lags = range(lag, min(lag + width, most_lag + 1))
        o = Window.partitionBy("g").orderBy("i")
        rows = d.join(open_.select(F.col("g").alias("og"), "power"), F.col("g") == F.col("og")).drop("og")
        sums = rows.select("g", "power", *[(F.col("x") * F.lead("x", k).over(o)).alias(f"c{k}") for k in lags]).groupBy("g").agg(F.first("power").alias("power"), F.count(F.lit(1)).alias("n"), *[F.sum(f"c{k}").alias(f"c{k}") for k in lags])
        first = F.coalesce(*[F.when(F.col(f"c{k}") / F.col("power") < F.exp(F.lit(-1.0)), F.lit(k)) for k in lags])
        block = written(sums.select("g", "power", "n", first.alias("lag")))
        crossed.append(block.where("lag is not null").select("g", "lag"))
        lag, width = lag + width, width * 2
        open_ = block.where(F.col("lag").isNull() & (F.col("n") > lag))
        if lag > most_lag or open_.isEmpty():
            break
    fell = reduce(lambda a, b: a.unionByName(b), crossed).withColumnRenamed("g", "fg")
    out = base.join(fell, F.col("g") == F.col("fg"), "left")
    tau = F.when((F.col("n") >= 5) & F.col("varied"), F.coalesce("lag", F.least(F.lit(most_lag), F.col("n").cast("int") - 1)) * dt)
    return out.select(*[F.col(f"g.{c}").alias(c) for c in by], tau.alias("tau"))


def autocorrelation_times(df: DataFrame, by: list[str], values: list[str], dt: float, most_lag: int | None = None, index: str = "t_idx") -> DataFrame:
    """W8 of several columns at once: <value>_tau_sec."""
    long = df.select(*by, index, F.explode(F.array(*[F.struct(F.lit(v).alias("of"), F.col(v).cast("double").alias("value")) for v in values])).alias("__x")).select(*by, index, "__x.of", "__x.value")
    tau = autocorrelation_time(long, [*by, "of"], "value", dt, most_lag, index)
    return tau.groupBy(*by).agg(*[F.max(F.when(F.col("of") == v, F.col("tau"))).alias(f"{v}_tau_sec") for v in values])


def time_step(df: DataFrame, by: list[str], time: str, index: str = "t_idx") -> DataFrame:
    """Median positive difference of time, 1 when there is none."""
    w = Window.partitionBy(*by).orderBy(index)
    d = df.withColumn("__d", F.col(time) - F.lag(time).over(w))
    return d.groupBy(*by).agg(F.coalesce(F.median(F.when(F.col("__d") > 0, F.col("__d"))), F.lit(1.0)).alias("dt"))


def stride(df: DataFrame, by: list[str], most: int = 2000, index: str = "t_idx") -> DataFrame:
    """Every ceil(n / most)-th row of keys with more than ``most`` rows; index is renumbered."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    step = F.when(F.col("__n") > most, F.ceil(F.col("__n") / most)).otherwise(1)
    return df.join(n, by).where(F.col(index) % step == 0).withColumn(index, (F.col(index) / step).cast("long")).drop("__n")


def super_windows(df: DataFrame, by: list[str], length: int = 3, index: str = "t_idx") -> DataFrame:
    """(by, window, center, member): overlapping runs of ``length`` indices; the centre is capped at T - 2."""
    t = df.groupBy(*by).agg(F.max(index).alias("__last"))
    w = t.select(*by, "__last", F.explode(F.expr(f"sequence(0L, greatest(__last - {length - 1}, 0))")).alias("window"))
    centre = F.least(F.col("window") + length // 2, F.col("__last") - 1)
    return w.withColumn("center", centre).select(*by, "window", "center", F.explode(F.expr(f"sequence(window, least(window + {length - 1}, __last))")).alias("member"))


def rolling_stability(df: DataFrame, by: list[str], value: str, width: int = 11, eps: float = 1e-12, index: str = "t_idx") -> DataFrame:
    """1 / (population std + eps) in a centred window, two values or more."""
    h = max(width, 3) // 2
    w = Window.partitionBy(*by).orderBy(index).rowsBetween(-h, h)
    return df.withColumn("stability", F.when(F.count(value).over(w) >= 2, 1 / (F.stddev_pop(value).over(w) + eps)))


def return_time(df: DataFrame, by: list[str], value: str, index: str = "t_idx", drop: float = 0.8, back: float = 0.9, time: str | None = None, baseline: float = 0.5) -> DataFrame:
    """From a value under drop * baseline quantile to the first later value of at least back times it: time, or else steps."""
    m = df.groupBy(*by).agg(F.percentile(value, F.lit(baseline)).alias("__m"))
    at = time or index
    w = Window.partitionBy(*by).orderBy(F.desc(index)).rowsBetween(Window.unboundedPreceding, -1)  # later rows, from the last on
    d = df.join(m, by)
    after = F.min(F.when(F.col(value) >= back * F.col("__m"), F.struct(F.col(index).alias("i"), F.col(at).alias("t")))).over(w)
    return d.withColumn("return_time", F.when(F.col(value) < drop * F.col("__m"), after["t"] - F.col(at))).drop("__m")


def middle(values: Column) -> Column:
    """Median of an array without nulls; null if it is empty."""
    a, n = F.sort_array(values), F.size(values)
    return F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2)


def with_hysteresis(df: DataFrame, by: list[str], values: dict[str, str], width: int = 11, index: str = "t_idx", time: str | None = None) -> DataFrame:
    """W17 of several columns (value -> new column) in one pass: |median of falling rows - median of rising rows| in a window.

    Windows are centred and of odd width (3 or more); a row falls or rises by its difference to the row before, the
    first does neither. With ``time``, the gap is multiplied by the central difference of time. A window's rows are
    gathered as an array of at most ``width`` values.
    """
    h = max(width, 3) // 2
    o = Window.partitionBy(*by).orderBy(index)
    d = df.withColumns({f"__g_{v}": F.coalesce(F.col(v) - F.lag(v).over(o), F.lit(0.0)) for v in values})
    d = d.withColumns({f"__w_{v}": F.collect_list(F.struct(F.col(v).alias("v"), F.col(f"__g_{v}").alias("g"))).over(o.rowsBetween(-h, h)) for v in values})
    if time is not None:
        d = central_difference(d, by, [time], index)
    of = lambda v, falling: middle(F.transform(F.filter(f"__w_{v}", lambda x: (x["g"] < 0 if falling else x["g"] > 0) & x["v"].isNotNull()), lambda x: x["v"]))
    step = F.col(f"{time}_dot") if time is not None else F.lit(1.0)
    d = d.withColumns({out: F.abs(of(v, True) - of(v, False)) * step for v, out in values.items()})
    return d.drop(*[f"__{n}_{v}" for v in values for n in "gw"], *([f"{time}_dot"] if time is not None else []))


def hysteresis(df: DataFrame, by: list[str], value: str, width: int = 11, index: str = "t_idx", time: str | None = None) -> DataFrame:
    """(by, index, gap) of one column, see ``with_hysteresis``."""
    return with_hysteresis(df, by, {value: "gap"}, width, index, time).select(*by, index, "gap")


def growth_ratio(df: DataFrame, by: list[str], value: str, index: str = "t_idx") -> DataFrame:
    """exp(x_i - x_(i-1))."""
    return df.withColumn("growth", F.exp(F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(index))))


def split_half(df: DataFrame, by: list[str], value: str, index: str = "t_idx") -> DataFrame:
    """Medians of both halves and rho, the rank correlation (ordinal ranks) of rows at equal places in them.

    Nulls keep their places and are left out of medians and ranks; n counts the places with both values. Fewer than
    four rows: nulls and n = 0; fewer than three such places: no rho.
    """
    w = Window.partitionBy(*by)
    d = df.withColumn("__i", F.row_number().over(w.orderBy(index)) - 1).withColumn("__all", F.count(F.lit(1)).over(w)).withColumn("__h", F.floor(F.col("__all") / 2).cast("int"))
    d = d.where("__i < 2 * __h or __all < 2").withColumn("__at", F.when(F.col("__h") > 0, F.col("__i") % F.col("__h")).otherwise(0))
    j = d.groupBy(*by, "__at").agg(F.max(F.when(F.col("__i") < F.col("__h"), F.col(value))).alias("a"), F.max(F.when(F.col("__i") >= F.col("__h"), F.col(value))).alias("b"), F.max("__all").alias("__all"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    rank = lambda c: F.when(both, F.row_number().over(Window.partitionBy(*by, both).orderBy(c, "__at")).cast("double"))
    r = j.withColumn("ra", rank("a")).withColumn("rb", rank("b"))
    enough, n = F.max("__all") >= 4, F.count("ra")
    rho = F.when(enough & (n >= 3), F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb")))
    return r.groupBy(*by).agg(F.when(enough, n).otherwise(F.lit(0)).alias("n"), F.when(enough, F.median("a")).alias("a_median"), F.when(enough, F.median("b")).alias("b_median"), rho.alias("rho"))


def central_difference(df: DataFrame, by: list[str], columns: list[str], index: str = "t_idx", dt: Column | None = None) -> DataFrame:
    """Half of next minus previous, one-sided at the ends, optionally over dt; columns get the suffix _dot."""
    o = Window.partitionBy(*by).orderBy(index)
    step = F.lit(1.0) if dt is None else dt
    for c in columns:
        ahead, behind = F.lead(c).over(o), F.lag(c).over(o)
        df = df.withColumn(f"{c}_dot", F.coalesce((ahead - behind) / 2, ahead - F.col(c), F.col(c) - behind, F.lit(0.0)) / step)
    return df


def time_speed(df: DataFrame, by: list[str], axes: list[str], time: str, index: str = "t_idx") -> DataFrame:
    """Median of |dx| / dt; dt = 0 counts as missing."""
    o = Window.partitionBy(*by).orderBy(index)
    v = _norm([F.col(a) - F.lag(a).over(o) for a in axes]) / F.nullif(F.col(time) - F.lag(time).over(o), F.lit(0.0))
    return df.withColumn("__v", v).groupBy(*by).agg(F.median("__v").alias("median_speed"))


def curvature(df: DataFrame, by: list[str], axes: list[str], index: str = "t_idx") -> DataFrame:
    """|second difference| / |first difference|^2, values at or above P99 left out when there are more than ten."""
    o = Window.partitionBy(*by).orderBy(index)
    first = [F.lead(a).over(o) - F.col(a) for a in axes]
    second = [F.lead(a, 2).over(o) - 2 * F.lead(a).over(o) + F.col(a) for a in axes]
    d = df.withColumn("__c", _norm(second) / F.nullif(_norm(first) ** 2, F.lit(0.0))).where("__c is not null")
    lim = d.groupBy(*by).agg(F.percentile("__c", F.lit(0.99)).alias("__p"), F.count(F.lit(1)).alias("__n"))
    kept = d.join(lim, by).where("__n <= 10 or __c < __p")
    return kept.groupBy(*by).agg(F.avg("__c").alias("mean_curvature"), F.stddev_pop("__c").alias("std_curvature"), F.count(F.lit(1)).alias("n"))


def centre(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Value minus the key's median, suffix _sc."""
    m = df.groupBy(*by).agg(*[F.median(c).alias(f"__{c}") for c in columns])
    return df.join(m, by).withColumns({f"{c}_sc": F.col(c) - F.col(f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def _centre_spread(df: DataFrame, by: list[str], values: list[str], large: bool) -> DataFrame:
    """Adds median, population std, mean and MAD of several columns at once; medians of large keys from refined ranges."""
    if large:
        order = quantiles(df, by, {v: F.col(v) for v in values}, {"median": 0.5}, "mad")
        m = df.groupBy(*by).agg(*[f(v).alias(f"__{n}_{v}") for v in values for n, f in (("std", F.stddev_pop), ("mean", F.avg))])
        m = m.join(order.select(*by, *[F.col(f"{v}_{c}").alias(f"__{n}_{v}") for v in values for n, c in (("med", "median"), ("mad", "mad"))]), by)
        return df.join(m, by)
    m = df.groupBy(*by).agg(*[f(v).alias(f"__{n}_{v}") for v in values for n, f in (("med", F.median), ("std", F.stddev_pop), ("mean", F.avg))])
    d = df.join(m, by)
    mad = d.groupBy(*by).agg(*[F.median(F.abs(F.col(v) - F.col(f"__med_{v}"))).alias(f"__mad_{v}") for v in values])
    return d.join(mad, by)


def _drop_spread(df: DataFrame, values: list[str]) -> DataFrame:
    return df.drop(*[f"__{n}_{v}" for n in ("med", "std", "mean", "mad") for v in values])


def robust_z(df: DataFrame, by: list[str], *values: str, large: bool = False) -> DataFrame:
    """(x - median) / MAD (unscaled), else / population std, else 0; columns z_<value>. ``large`` as in A2."""
    d = _centre_spread(df, by, list(values), large)
    for v in values:
        gap = F.col(v) - F.col(f"__med_{v}")
        z = F.when(F.col(v).isNull(), None).when(F.col(f"__mad_{v}") > 1e-12, gap / F.col(f"__mad_{v}")).when(F.col(f"__std_{v}") > 1e-12, gap / F.col(f"__std_{v}")).otherwise(0.0)
        d = d.withColumn(f"z_{v}", z)
    return _drop_spread(d, list(values))


def logistic_normalise(df: DataFrame, by: list[str], names: dict[str, str], large: bool = False) -> DataFrame:
    """Logistic of z by 1.4826 MAD around the median, else by std around the mean, else 0.5; value -> new column."""
    d = _centre_spread(df, by, list(names), large)
    for v, out in names.items():
        z = F.when(F.col(f"__mad_{v}") > 1e-12, (F.col(v) - F.col(f"__med_{v}")) / (1.4826 * F.col(f"__mad_{v}"))).when(F.col(f"__std_{v}") > 1e-12, (F.col(v) - F.col(f"__mean_{v}")) / F.col(f"__std_{v}")).otherwise(0.0)
        d = d.withColumn(out, F.when(F.col(v).isNotNull(), 1 / (1 + F.exp(-z))))
    return _drop_spread(d, list(names))


def min_max(df: DataFrame, by: list[str], value: str, out: str = "scaled") -> DataFrame:
    """(x - min) / (max - min) by key, 0 when constant."""
    m = df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")) if by else df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    d = df.join(m, by) if by else df.crossJoin(F.broadcast(m))  # one row
    return d.withColumn(out, F.when(F.col("__hi") > F.col("__lo"), (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).when(F.col(value).isNotNull(), 0.0)).drop("__lo", "__hi")


def stage_slices(df: DataFrame, session: str, code: str, codebook: dict[int, str], least: int) -> DataFrame:
    """Rows of mapped codes with enough rows; key = session:stage_<label>."""
    book = F.create_map(*[F.lit(x) for kv in codebook.items() for x in kv])
    d = df.withColumn("label", F.element_at(book, F.col(code))).where("label is not null")
    n = d.groupBy(session, "label").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).drop("__n")
    return d.join(n, [session, "label"], "left_semi").withColumn("slice", F.concat(F.col(session).cast("string"), F.lit(":stage_"), F.col("label")))


def matched_subsample(df: DataFrame, by: list[str], condition: str, order: Column, tie: str) -> DataFrame:
    """As many rows of each condition as the key's rarest condition has, the first by a hash order."""
    n = df.groupBy(*by, condition).agg(F.count(F.lit(1)).alias("__c")).groupBy(*by).agg(F.min("__c").alias("__n"))
    k = F.row_number().over(Window.partitionBy(*by, condition).orderBy(order, tie))
    return df.withColumn("__k", k).join(n, by).where("__k <= __n").drop("__k", "__n")


def density_matched(df: DataFrame, by: list[str], count: str, value: str, least: int = 5) -> DataFrame:
    """Median of rows whose count is at most the key's median count; fewer than ``least`` rows: null."""
    m = df.groupBy(*by).agg(F.median(count).alias("__m"))
    kept = df.join(m, by).where(F.col(count) <= F.col("__m"))
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n_kept"), F.when(F.count(F.lit(1)) >= least, F.median(value)).alias("median"))


def p_rank(df: DataFrame, by: list[str], p: str, tie: str) -> DataFrame:
    """Place by p, nulls last."""
    return df.withColumn("p_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last(), tie)))


def step_spread(df: DataFrame, by: list[str], axes: list[str], index: str = "t_idx") -> DataFrame:
    """Median, interquartile range and MAD of speed and of turning angle, and the number of speeds."""
    s = steps(df, by, axes, index).select(*by, "speed", F.col("angle").alias("curvature"))
    both = ("speed", "curvature")
    out = s.groupBy(*by).agg(F.count("speed").alias("n_speeds"), *[f for c in both for f in (F.median(c).alias(f"{c}_median"), (F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))).alias(f"{c}_iqr"))])
    mad = s.join(out, by).groupBy(*by).agg(*[F.median(F.abs(F.col(c) - F.col(f"{c}_median"))).alias(f"{c}_mad") for c in both])
    return out.join(mad, by)


def dynamics(df: DataFrame, by: list[str], axes: list[str], dt: float, most_lag: int | None = None, least: int = 5, index: str = "t_idx", session: list[str] | None = None, levels: DataFrame | None = None) -> DataFrame:
    """Path, speed, turning, entropies, autocorrelation times and mean-median gaps by key, for keys with ``least`` rows or more.

    Columns have the names that roles and families of metrics (D2) go by. For slices of sessions (W11) ``levels`` holds
    the corner levels of the whole sessions, named by ``session``.
    """
    finite = reduce(lambda p, q: p & q, [F.col(a).isNotNull() for a in axes])
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_timepoints"), F.min(finite).alias("finite_ok"), *[(F.avg(a) - F.median(a)).alias(f"{a}_delta_mean_median") for a in axes]).where(F.col("n_timepoints") >= least)
    codes = corner_codes(df, session or by, axes, levels=levels)
    out = n.join(path_summary(df, by, axes, index), by, "left").join(step_spread(df, by, axes, index), by, "left")
    out = out.withColumn("not_testable", F.col("n_speeds") < 1).withColumn("not_testable_reason", F.when(F.col("n_speeds") < 1, "lt_min_timepoints_or_no_speed")).drop("n_speeds")
    for name, f in (("corner_entropy", occupancy_entropy(codes, by)), ("corner_dwell_entropy", dwell_entropy(codes, by, index)), ("corner_transition_entropy", transition_entropy(codes, by, index))):
        out = out.join(f.withColumnRenamed("entropy", name), by, "left")
    return out.join(autocorrelation_times(df, by, axes, dt, most_lag, index), by, "left")
