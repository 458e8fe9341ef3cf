"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

A source with token share p gets weight p^a / sum(p^a). The exponent a in [0, 1] is bisected: it is the largest at
which the entropy of the weights reaches ``entropy`` (a share of log(number of sources)), but never so small that a
source would be repeated more than ``repeats`` times. Without ``entropy``, ``repeats`` alone decides: the exponent is the
smallest within the limit; without either it is 1. Each job evaluates fifteen exponents at once, four bisection
levels, over the table of source totals; only those fifteen sums come back.

The budget is the least with which every source is used whole at least once, so nothing is dropped unless a smaller
``budget`` (tokens) is asked for. A source with c tokens and budget b is used floor(b / c) times whole, each time in a
permutation of its own (order of a hash of epoch and row), and once more in part: the documents of the last
permutation whose preceding tokens stay under what is left. Running sums go by hash ranges of a source, as many as
keep both a range's rows and a source's ranges near the square root of its rows, so a source that holds a third of all
rows is not gathered anywhere.

Cases: null and empty texts have no tokens and go wherever their place falls; a source without tokens has weight 0
and each of its rows comes once; null is a source of its own; rows of a source with the same id and text stand at one
place of its permutation and are taken together, whatever other sources do with theirs; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import boxed, cut, small

LEVELS = 4
#: Rows of a hash range, at least.
RANGE_ROWS = 5_000


def tokens(text: Column) -> Column:
    """Number of runs without white space (null: 0)."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), "")).cast("long")


def _measures(totals: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """For each exponent: entropy of the weights, largest ratio of repetitions."""
    grid = totals.where("tokens > 0").select("tokens", F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a"))
    x = grid.select("a", F.pow(F.col("tokens").cast("double"), F.col("a")).alias("u"), F.pow(F.col("tokens").cast("double"), F.col("a") - 1).alias("e"))
    got = x.groupBy("a").agg(F.sum("u").alias("z"), F.sum(F.col("u") * F.log("u")).alias("s"), F.max("e").alias("most"), F.min("e").alias("least")).collect()
    return {r["a"]: (math.log(r["z"]) - r["s"] / r["z"], r["most"] / r["least"]) for r in got}


def fit_exponent(totals: DataFrame, entropy: float | None, repeats: float | None, rounds: int = 8) -> float:
    """The largest exponent that reaches the target entropy, or else the smallest that keeps the repetition limit."""
    head = totals.where("tokens > 0").agg(F.count(F.lit(1)).alias("n")).first()
    if head["n"] < 2:
        return 1.0
    target = None if entropy is None else entropy * math.log(head["n"])

    def bisect(good) -> tuple[float, float]:
        """good holds at 0 and from there up to some point: the points just before and after that."""
        low, high = 0.0, 1.0
        if good(*_measures(totals, [1.0])[1.0]):
            return 1.0, 1.0
        for _ in range(rounds):
            points = [low + (high - low) * i / 2**LEVELS for i in range(1, 2**LEVELS)]
            at = _measures(totals, points)
            low, high = max([low, *(p for p in points if good(*at[p]))]), min([high, *(p for p in points if not good(*at[p]))])
        return low, high

    if target is None:
        by_entropy = 1.0 if repeats is None else 0.0
    else:
        by_entropy = bisect(lambda h, _: h >= target - 1e-12)[0]
    if repeats is None or _measures(totals, [0.0])[0.0][1] <= repeats:
        return by_entropy
    return max(by_entropy, bisect(lambda _, r: r > repeats)[1])  # from there up to 1 the limit holds


def plan(totals: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None) -> DataFrame:
    """(source, tokens, weight, epochs, exponent) of every source, from its (source, tokens)."""
    a = fit_exponent(totals, entropy, repeats)
    sums = totals.agg(F.sum(F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a)))).alias("z"), F.max(F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(1 - a)))).alias("m")).first()
    z, m = sums["z"] or 1.0, sums["m"] or 1.0
    spend = float(budget) if budget is not None else z * m
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a)) / F.lit(z)).otherwise(0.0)
    # rounded, so that the source that sets the budget is used once and not a hair less
    epochs = F.when(F.col("tokens") > 0, F.round(weight * F.lit(spend) / F.col("tokens"), 9)).otherwise(1.0)
    return totals.select("source", "tokens", weight.alias("weight"), epochs.alias("epochs"), F.lit(a).alias("exponent"))


def mix(documents: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None, seed: int = 0, ids_only: bool = False) -> DataFrame:
    """The documents as the mixture uses them, with epoch (0, 1, ...) and order (place in the epoch's permutation).

    With ``ids_only``, columns are doc_id, source, n_tokens, epoch, order; else all columns of ``documents``, then
    __epoch and __order.
    """
    rows = cut(documents.select("doc_id", "source", tokens(F.col("text")).alias("n_tokens"), F.xxhash64("doc_id", "text").alias("row")))
    totals = cut(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    sources = small(cut(plan(totals, entropy, repeats, budget).select(F.col("source").alias("__s"), "tokens", "epochs")))

    # documents of the last, partial permutation: running sums by ranges of the hash
    placed = rows.join(sources, F.col("source").eqNullSafe(F.col("__s")))
    part = placed.select("doc_id", "row", "source", "n_tokens", F.xxhash64(F.lit(seed), F.floor("epochs").cast("int"), "row").alias("order"), ((F.col("epochs") - F.floor("epochs")) * F.col("tokens")).alias("left"))
    most = totals.agg(F.max("rows").alias("n")).first()["n"] or 1
    bits = max(0, math.ceil(math.log2(most / max(RANGE_ROWS, math.sqrt(most)))))
    part = part.withColumn("range", F.shiftrightunsigned("order", 64 - bits) if bits else F.lit(0).cast("long")).where("left > 0")
    held = part.groupBy("source", "range").agg(F.sum("n_tokens").alias("held"))
    before = held.select(F.col("source").alias("r_source"), F.col("range").alias("r_range"), (F.sum("held").over(Window.partitionBy("source").orderBy("range")) - F.col("held")).alias("before"))
    inside = Window.partitionBy("source", "range").orderBy(F.col("order") < 0, "order", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    ran = part.withColumn("ran", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    chosen = ran.join(before, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range"))).where(F.col("ran") + F.col("before") < F.col("left"))
    extra = chosen.select(F.col("doc_id").alias("__d"), F.col("row").alias("__r"), F.col("source").alias("__of")).distinct()

    if ids_only:
        each = rows.select("doc_id", "source", "n_tokens", F.col("row").alias("__row"))
        id_, source = F.col("doc_id"), F.col("source")
    else:
        id_, source = F.col("__doc.doc_id"), F.col("__doc.source")
        each = boxed(documents, "__epoch", "__order").withColumn("__row", F.xxhash64(id_, F.col("__doc.text")))
        extra = small(cut(extra))
    each = each.join(sources.select("__s", F.floor("epochs").cast("int").alias("__whole")), source.eqNullSafe(F.col("__s")), "left")
    each = each.join(extra, id_.eqNullSafe(F.col("__d")) & (F.col("__row") == F.col("__r")) & source.eqNullSafe(F.col("__of")), "left")
    last = F.when(F.col("__r").isNotNull(), F.col("__whole")).otherwise(F.col("__whole") - 1)
    each = each.withColumn("__epoch", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last)))).where("__epoch is not null")
    order = F.xxhash64(F.lit(seed), F.col("__epoch"), F.col("__row"))
    if ids_only:
        return each.select("doc_id", "source", "n_tokens", F.col("__epoch").alias("epoch"), order.alias("order"))
    return each.select("__doc.*", "__epoch", order.alias("__order"))
