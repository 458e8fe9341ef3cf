"""The long metric table: melting, roles and families, derived indices, manifests and effect tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.aggregates import keep_first, pivot
from tideline.operators.joins import null_safe
from tideline.operators.sequences import min_max, robust_z

#: Metric names and prefixes that are quality metrics, and name parts that decide a family.
QC_NAMES = ["n_regions", "n_timepoints", "n_windows", "dims", "horizon", "k"]
QC_PREFIXES = ["pred_err_", "split_half_", "near_singular_", "jacobian_cond"]
JACOBIAN_PARTS = ["trace", "rotation", "frobenius", "spectral", "anisotropy"]
TRAJECTORY_PARTS = ["speed", "curvature", "corner_", "path_length", "endpoint_dist", "efficiency", "_tau_sec", "_delta_mean_median"]
#: Reachability metrics and the names they are published under again.
ALIASES = {"q_ratio_h4_median": "q_ratio_h4", "tube_q_ratio_h4_median": "q_ratio_h4", "tube_capture_gate_median": "capture_gate", "tube_a_operator_norm_median": "a_operator_norm"}


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def metric_columns(df: DataFrame, not_metrics: list[str]) -> list[str]:
    """Numeric, non-boolean columns that aren't keys, context, provenance or flags."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in not_metrics]


def melt(df: DataFrame, keep: list[str], metrics: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """Wide to (keys, metric, value), optionally only listed metrics."""
    names = [m for m in (metrics or metric_columns(df, keep)) if only is None or m in only]
    return df.select(*keep, *[F.col(m).cast("double").alias(m) for m in names]).unpivot(keep, names, "metric", "value")


def role_and_family(df: DataFrame, metric: str = "metric") -> DataFrame:
    """metric_role (qc or signal) and metric_family."""
    m = F.col(metric)
    role = F.when(m.isin(QC_NAMES) | m.endswith("_finite_frac") | _any(m.startswith(p) for p in QC_PREFIXES), "qc").otherwise("signal")
    family = F.when(_any(m.startswith(p) for p in ("tube_", "cone_", "persistence_")), "reachability").when(m.contains("block_"), "block")
    family = family.when(_any(m.contains(p) for p in JACOBIAN_PARTS), "jacobian").when(_any(m.contains(p) for p in TRAJECTORY_PARTS), "trajectory").otherwise(F.substring_index(m, "_", 1))
    return df.withColumn("metric_role", role).withColumn("metric_family", family)


def metric_of(long: DataFrame, keys: list[str], names: list[str], out: str, order: str) -> DataFrame:
    """The first available of several metrics, one value per key (first row wins)."""
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("metric"))
    rows = long.where(F.col("metric").isin(names) & F.col("value").isNotNull())
    return keep_first(rows, keys, [rank, F.col(order)]).select(*keys, F.col("value").alias(out))


def adaptive_index(long: DataFrame, keys: list[str], by: list[str], order: str, speed: list[str], rotation: str, anisotropy: str) -> DataFrame:
    """D3: reduced = z(speed) + z(rotation); full = reduced - z(anisotropy); z within ``by``."""
    j = null_safe(metric_of(long, keys, speed, "speed", order), metric_of(long, keys, [rotation], "rotation", order), keys)
    j = null_safe(j, metric_of(long, keys, [anisotropy], "anisotropy", order), keys, "left")
    j = robust_z(j, by, "speed", "rotation", "anisotropy")
    return j.withColumn("reduced", F.col("z_speed") + F.col("z_rotation")).withColumn("full", F.col("reduced") - F.col("z_anisotropy"))


def asymmetry(long: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Sum over pairs of |a - b| / (|a| + |b| + 1e-12), pairs with a null skipped; at least one pair."""
    names = sorted({n for p in pairs for n in p})
    wide = pivot(long, keys, "metric", names, F.min("value"))
    parts = [F.abs(F.col(a) - F.col(b)) / (F.abs(F.col(a)) + F.abs(F.col(b)) + 1e-12) for a, b in pairs]
    seen = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return wide.select(*keys, F.when(seen >= 1, sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))).alias("asymmetry"))


def publish_aliases(long: DataFrame, keys: list[str], order: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rows of aliased metrics under their other names, the first per key and name."""
    names = F.create_map(*[F.lit(x) for kv in (aliases or ALIASES).items() for x in kv])
    return keep_first(long.withColumn("metric", F.element_at(names, F.col("metric"))).where("metric is not null"), [*keys, "metric"], [F.col(order)])


def traversability(long: DataFrame, keys: list[str], by: list[str], order: str, speed: list[str], anisotropy: str) -> DataFrame:
    """Speed * (1 - min-max of anisotropy), scaled within ``by`` (all rows when empty)."""
    j = null_safe(metric_of(long, keys, speed, "speed", order), metric_of(long, keys, [anisotropy], "anisotropy", order), keys)
    return min_max(j, by, "anisotropy").withColumn("traversability", F.col("speed") * (1 - F.col("scaled")))


def flatten_manifest(df: DataFrame, keys: list[str], manifest: str, leaves: list[str]) -> DataFrame:
    """Numeric leaves of a JSON tree as one column each; a.b[0] is named a_b_0."""
    name = lambda p: p.replace(".", "_").replace("[", "_").replace("]", "")
    v = F.parse_json(manifest)
    return df.select(*keys, *[F.try_variant_get(v, f"$.{p}", "double").alias(name(p)) for p in leaves])


def explode_manifest(df: DataFrame, keys: list[str], manifest: str) -> DataFrame:
    """One row per numeric entry of a flat JSON object: (keys, metric, value)."""
    m = F.from_json(manifest, "map<string,double>")
    return df.select(*keys, F.explode(m).alias("metric", "value")).where("value is not null")


def category_long(df: DataFrame, keys: list[str], columns: list[str], names: dict[str, str]) -> DataFrame:
    """Selected metrics in long form with their display coordinate; text that isn't a number goes."""
    cast = df.select(*keys, *[F.try_to_number(F.col(c), F.lit("999999999.999999")).cast("double").alias(c) if dict(df.dtypes)[c] == "string" else F.col(c).cast("double").alias(c) for c in columns])
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return cast.unpivot(keys, columns, "metric", "value").where("value is not null").withColumn("coordinate", F.coalesce(F.element_at(m, F.col("metric")), F.col("metric")))


def stars(q: Column) -> Column:
    return F.when(q < 0.001, "***").when(q < 0.01, "**").when(q < 0.05, "*").otherwise("")


def effect_matrix(df: DataFrame, row: str, column: str, columns: list[str]) -> DataFrame:
    """One row per contrast; a cell is the effect with two decimals and stars by q, else p."""
    cell = F.concat(F.when(F.col("effect").isNotNull(), F.format_string("%.2f", "effect")), stars(F.coalesce("q", "p")))
    return pivot(df.withColumn("__cell", cell), [row], column, columns, F.max("__cell"))


def norms(df: DataFrame, dots: list[str], coords: list[str]) -> DataFrame:
    """Speed and norm where the columns are absent."""
    size = lambda cs: F.sqrt(reduce(lambda a, b: a + b, [F.col(c) ** 2 for c in cs]))
    for name, cs in (("speed", dots), ("norm", coords)):
        df = df if name in df.columns else df.withColumn(name, size(cs))
    return df


def append(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns by name, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def top_effects(df: DataFrame, by: list[str], effect: str, k: int, tie: str) -> DataFrame:
    """The k rows with the largest absolute effect per key, nulls last."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.abs(F.col(effect)).desc_nulls_last(), tie))
    return df.withColumn("place", n).where(F.col("place") <= k)


def compare_families(a: DataFrame, b: DataFrame, names: tuple[str, str], effect: str) -> DataFrame:
    """Per family the number of effects, the largest and the median absolute effect."""
    both = append(a.withColumn("family", F.lit(names[0])), b.withColumn("family", F.lit(names[1])))
    return both.groupBy("family").agg(F.count(effect).alias("n"), F.max(F.abs(F.col(effect))).alias("largest"), F.median(F.abs(F.col(effect))).alias("median"))


def best_available(df: DataFrame, keys: list[str], metric: str, p: str, candidates: list[str]) -> DataFrame:
    """The first candidate (in order) with a non-null p, per key."""
    rank = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col(metric))
    return df.where((rank > 0) & F.col(p).isNotNull()).groupBy(*keys).agg(F.min_by(metric, rank).alias(metric), F.min_by(p, rank).alias(p))
