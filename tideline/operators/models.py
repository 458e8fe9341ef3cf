"""Incremental value of features: cross-validated logistic models with and without them.

All folds of both models are fitted together: a pass over the rows sums gradients and curvatures of every fit in Arrow
batches, and a Newton step is solved on those few sums. The number of passes is that of the steps, whatever the folds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.resample import uniform
from tideline.operators.stats import auc, ordered
from tideline.sources.scan import written

#: Ridge on standardised features (not on the intercept), most Newton steps, step length at which fits are done.
RIDGE, STEPS, DONE = 1e-3, 25, 1e-8


def stratified_folds(df: DataFrame, item: str, label: str, folds: int, seed: int = 0) -> DataFrame:
    """Adds fold: within a class, rows go to folds in turn in the order of a hash, so classes are spread evenly.

    Places in a class are counted by ranges of the hash: a class may be a large part of all rows.
    """
    placed = ordered(df.withColumn("__u", uniform(seed, F.lit(0), item, "fold")), [label], ["__u", item])
    return placed.withColumn("fold", (F.col("__before") % folds).cast("int")).drop("__u", "__part", "__before")


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (rows, features), labels, folds of a batch."""
    n = len(batch)
    x = np.asarray(batch.column("x").flatten(), float).reshape(n, -1) if n else np.zeros((0, 1))
    return x, np.asarray(batch.column("y"), float), np.asarray(batch.column("fold"))


def _summed(rows: DataFrame, kernel, size: int) -> np.ndarray:
    """Sums over all rows of what ``kernel`` gives for a batch: ``size`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += kernel(*_rows(batch)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["sums"])

    each = rows.select("x", "y", "fold").mapInArrow(run, "sums array<double>")
    out = np.zeros(size)
    for r in each.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect():
        out[r["i"]] = r["s"]
    return out


def fit_folds(rows: DataFrame, d: int, folds: int, models: list[list[int]]) -> np.ndarray:
    """(models, folds, 1 + d): intercept and raw coefficients of each model without each fold's rows, from (x, y, fold).

    ``models`` lists the features that each model sees; others get 0.
    """

    def moments(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        own = fold[:, None] == np.arange(folds)
        return np.concatenate([own.sum(0)[:, None], own.T.astype(float) @ x, own.T.astype(float) @ (x * x)], 1)

    held = _summed(rows, moments, folds * (1 + 2 * d)).reshape(folds, -1)
    train = held.sum(0) - held
    n, mean = train[:, 0], train[:, 1 : 1 + d] / train[:, :1]
    spread = np.sqrt(np.maximum(train[:, 1 + d :] - n[:, None] * mean**2, 0) / np.maximum(n - 1, 1)[:, None])
    scale = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1), 0)  # a constant feature has no weight
    w = np.zeros((len(models), folds, 1 + d))
    seen = np.zeros((len(models), 1 + d), bool)
    for m, features in enumerate(models):
        seen[m, [0, *(1 + f for f in features)]] = True
    ridge = np.r_[0, np.full(d, RIDGE)]

    def curvature(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = np.zeros((len(models), folds, 1 + d, 2 + d))
        for f in range(folds):
            use = fold != f
            z = np.concatenate([np.ones((int(use.sum()), 1)), (x[use] - mean[f]) * scale[f]], 1)
            for m in range(len(models)):
                p = 1 / (1 + np.exp(-np.clip(z @ w[m, f], -700, 700)))
                out[m, f, :, 0] = z.T @ (p - y[use])
                out[m, f, :, 1:] = z.T @ (z * (p * (1 - p))[:, None])
        return out

    for _ in range(STEPS):
        sums = _summed(rows, curvature, w.size * (2 + d)).reshape(len(models), folds, 1 + d, 2 + d)
        gradient = sums[..., 0] / n[None, :, None] + ridge * w
        hessian = sums[..., 1:] / n[None, :, None, None] + np.diag(ridge)
        free = seen[:, None, :] & np.ones((1, folds, 1), bool)
        pinned = ~free
        hessian = np.where(pinned[..., None] | pinned[..., None, :], np.eye(1 + d), hessian) + 1e-12 * np.eye(1 + d)
        step = np.linalg.solve(hessian, np.where(free, gradient, 0)[..., None])[..., 0]
        w = w - step
        if np.abs(step).max() < DONE:
            break
    raw = w[..., 1:] * scale
    return np.concatenate([w[..., :1] - (raw * mean).sum(-1, keepdims=True), raw], -1)


def incremental_auc(df: DataFrame, item: str, label: str, base: list[str], extra: list[str], folds: int = 5, seed: int = 0, least: int = 3) -> DataFrame:
    """Mean and population deviation over folds of the held-out AUC, for the base features and for base plus extra.

    Both see the same complete rows and stratified folds: as many as ``folds`` and the smaller class allow. Fewer than
    ``least`` rows of a class give nulls. n is the number of complete rows, n_class that of the smaller class.
    """
    full = written(df.dropna(subset=[*base, *extra, label]))
    counts = {r[label]: r["n"] for r in full.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    fewest = min(counts.values()) if len(counts) == 2 else 0
    n = sum(counts.values())
    if fewest < least:
        none = [(m, None, None, n, fewest) for m in ("base", "full")]
        return full.sparkSession.createDataFrame(none, "model string, auc double, auc_sd double, n long, n_class long")
    folds, features = min(folds, fewest), [*base, *extra]
    dealt = stratified_folds(full, item, label, folds, seed)
    rows = written(dealt.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(label).cast("double").alias("y"), "fold"))
    w = fit_folds(rows, len(features), folds, [list(range(len(base))), list(range(len(features)))])
    fits = [(name, f, [float(c) for c in w[m, f]]) for m, name in enumerate(("base", "full")) for f in range(folds)]
    fits = F.broadcast(full.sparkSession.createDataFrame(fits, "model string, of int, w array<double>"))  # two rows a fold
    score = F.col("w")[0] + sum((F.col("w")[i + 1] * F.col("x")[i] for i in range(len(features))), F.lit(0.0))
    scored = rows.join(fits, F.col("fold") == F.col("of")).select("model", "fold", F.col("y").alias(label), score.alias("score"))
    out = auc(scored, ["model", "fold"], "score", label, large=True)
    return out.groupBy("model").agg(F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("auc_sd"), F.lit(n).cast("long").alias("n"), F.lit(fewest).cast("long").alias("n_class"))
