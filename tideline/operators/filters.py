"""Selectors, quality gates, validity rules, layer choice and sample selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def finite(c: Column) -> Column:
    """``c`` where it is a finite number, else null."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def select_rows(df: DataFrame, selector: dict) -> DataFrame:
    """AND of equality or membership; an unknown column matches nothing, null never matches."""
    if any(c not in df.columns for c in selector):
        return df.where(F.lit(False))
    return df.where(_all(F.col(c).isin(list(v) if isinstance(v, (list, tuple, set)) else [v]) for c, v in selector.items()))


def qc_gate(df: DataFrame, exclude_limited: bool = False) -> DataFrame:
    """finite_ok (default true), not not_testable (default false), optionally not validity_limited, value finite."""
    flag = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in df.columns else F.lit(default)
    keep = flag("finite_ok", True) & ~flag("not_testable", False) & finite(F.col("value")).isNotNull()
    return df.where(keep & ~flag("validity_limited", False) if exclude_limited else keep)


def _reason(df: DataFrame, column: str, rule: dict) -> list[Column]:
    if column not in df.columns:
        return [F.lit(f"{column}_missing")]
    c, out = F.col(column), []
    say = lambda condition, text: out.append(F.when(condition, F.lit(text)))
    if "min" in rule or "max" in rule:
        v = finite(c)
        say(v.isNull(), f"{column}_nonfinite")
        if "min" in rule:
            say(v < rule["min"], f"{column}_lt_{rule['min']}")
        if "max" in rule:
            say(v > rule["max"], f"{column}_gt_{rule['max']}")
    if rule.get("require_true"):
        say(~F.coalesce(c.cast("boolean"), F.lit(False)), f"{column}_false")
    if rule.get("require_false"):
        say(F.coalesce(c.cast("boolean"), F.lit(True)), f"{column}_true")
    if rule.get("require_nonnull"):
        say(c.isNull(), f"{column}_null")
    return out


def validity(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """adds validity_reasons (joined by ';' in rule order, empty if valid) and validity_limited."""
    reasons = [r for column, rule in rules.items() for r in _reason(df, column, rule)]
    joined = F.concat_ws(";", *reasons) if reasons else F.lit("")
    return df.withColumn("validity_reasons", joined).withColumn("validity_limited", F.col("validity_reasons") != "")


def window_mask(df: DataFrame, flag: str, support: str | None, anchors: list[str], least_support: float = 0.3, least_anchors: int = 1) -> DataFrame:
    """adds window_ok. An absent column passes, null support passes."""
    keep = [F.col(flag) == 1] if flag in df.columns else []
    if support in df.columns:
        keep.append(F.col(support).isNull() | (F.col(support) >= least_support))
    present = [a for a in anchors if a in df.columns]
    if present:
        keep.append(sum((F.col(a).isNotNull().cast("int") for a in present), F.lit(0)) >= least_anchors)
    return df.withColumn("window_ok", F.coalesce(_all(keep), F.lit(False)))


def choose_layer(sessions: DataFrame, layers: DataFrame, requested: str, order: list[str]) -> DataFrame:
    """one layer for each session.

    ``sessions``: session, version, primary_layer. ``layers``: session, layer, contract. The requested contract wins, the
    session's primary layer first; sessions of version 2.1 and later never fall back, older ones fall back
    along ``order``. Adds resolved (the contract found).
    """
    rank = F.coalesce(F.array_position(F.array(*[F.lit(o) for o in order]), F.col("contract")), F.lit(0)).cast("int")
    asked = F.col("contract") == requested
    joined = layers.join(sessions, "session")
    level = F.when(asked & (F.col("layer") == F.col("primary_layer")), 0).when(asked, 1).when((F.col("version") < 2.1) & (rank > 0), 1 + rank)
    ranked = joined.withColumn("level", level).where("level is not null")
    first = F.row_number().over(Window.partitionBy("session").orderBy("level", "layer"))
    return ranked.withColumn("n", first).where("n = 1").select("session", "layer", F.col("contract").alias("resolved"))


def gate_geometry(df: DataFrame, degenerate: str, retained: str, metrics: list[str]) -> DataFrame:
    """F8: not_testable with its reasons where axes are degenerate or no window is retained; metrics become null."""
    bad_axes = F.when(F.size(degenerate) > 0, F.concat(F.lit("degenerate axes: "), F.array_join(degenerate, ",")))
    none_left = F.when(F.coalesce(F.col(retained), F.lit(0)) <= 0, F.lit("no retained windows"))
    out = df.withColumn("reason", F.concat_ws("; ", bad_axes, none_left)).withColumn("not_testable", F.col("reason") != "")
    return out.withColumns({m: F.when(~F.col("not_testable"), F.col(m)) for m in metrics})


def drop_disabled(df: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """anti-join with the disabled pairs."""
    return df.join(rules.select(*keys).distinct(), keys, "left_anti")


def fill_condition(df: DataFrame) -> DataFrame:
    """null condition takes the task."""
    return df.withColumn("condition", F.coalesce("condition", "task"))


def drop_flagged(df: DataFrame, flag: str) -> DataFrame:
    """rows with the flag at 1 go, null stays."""
    return df.where(F.coalesce(F.col(flag), F.lit(0)) != 1)


def intersection_sample(df: DataFrame, conditions: list[str], least: int = 10) -> DataFrame:
    """subjects with rows in all conditions, their counts and max(least, smallest count)."""
    counts = [F.count(F.when(F.col("condition") == c, 1)).alias(f"n_{c}") for c in conditions]
    per = df.where(F.col("condition").isin(conditions)).groupBy("subject").agg(*counts)
    low = F.least(*[F.col(f"n_{c}") for c in conditions]) if len(conditions) > 1 else F.col(f"n_{conditions[0]}")
    return per.where(low > 0).withColumn("min_rows", F.greatest(low, F.lit(least)).cast("long"))


def binned_category(df: DataFrame, score: str, low: float = 13, high: float = 20) -> DataFrame:
    """scores up to ``low`` and from ``high`` become bins, others go; category = group:condition."""
    bins = F.when(F.col(score) <= low, "low").when(F.col(score) >= high, "high")
    return df.withColumn("bin", bins).where("bin is not null").withColumn("category", F.concat_ws(":", "group", "condition"))


def eligibility(df: DataFrame, conditions: tuple[str, str], passed: str, least: float = 0.3) -> DataFrame:
    """pass rate per subject in both conditions, eligible when both reach ``least``, low when one is under 0.5."""
    rates = [F.avg(F.when(F.col("condition") == c, F.col(passed).cast("double"))).alias(f"rate_{c}") for c in conditions]
    r = [F.col(f"rate_{c}") for c in conditions]
    both = df.groupBy("subject").agg(*rates)
    return both.withColumn("eligible", F.coalesce((r[0] >= least) & (r[1] >= least), F.lit(False))).withColumn("low", F.coalesce((r[0] < 0.5) | (r[1] < 0.5), F.lit(False)))


def two_groups(df: DataFrame, left: tuple[str, str | None], right: tuple[str, str | None]) -> DataFrame:
    """rows of two ``group[:condition]`` sides; a condition that leaves no rows is ignored."""
    out = None
    for side, (group, condition) in (("left", left), ("right", right)):
        rows = df.where(F.col("group") == group).withColumn("side", F.lit(side))
        if condition is not None:
            hit = F.coalesce(F.col("condition") == condition, F.lit(False))
            any_hit = rows.agg(F.coalesce(F.max(hit.cast("int")), F.lit(0)).alias("any_hit"))  # one row
            rows = rows.crossJoin(F.broadcast(any_hit)).where(hit | (F.col("any_hit") == 0)).drop("any_hit")
        out = rows if out is None else out.unionByName(rows)
    return out
