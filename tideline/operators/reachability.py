"""Local linear dynamics: neighbours -> moments -> ridge models -> propagated covariances -> cone metrics.

Everything that touches many rows (neighbours, transitions, moment sums, medians) is joins and aggregations; one row
per window then carries its moment sums, and small matrices are solved as numpy stacks, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators.joins import neighbours
from tideline.operators.sequences import growth_ratio, rolling_stability, split_half, super_windows, with_hysteresis
from tideline.sources.scan import written

EPS = 1e-12


def transitions(df: DataFrame, by: list[str], axes: list[str], k: int = 20, index: str = "t_idx") -> DataFrame:
    """(by, window, center, source, x..., y...): distinct neighbours of each super-window with their next point."""
    near = neighbours(df, by, index, axes, k).select(*by, F.col(index).alias("member"), F.col("neighbour").alias("source"))
    w = super_windows(df, by, 3, index).join(near, [*by, "member"]).select(*by, "window", "center", "source").distinct()
    now = df.select(*by, F.col(index).alias("source"), *[F.col(a).alias(f"x_{a}") for a in axes])
    after = df.select(*by, (F.col(index) - 1).alias("source"), *[F.col(a).alias(f"y_{a}") for a in axes])
    return w.join(now, [*by, "source"]).join(after, [*by, "source"]).dropna(subset=[f"{s}_{a}" for s in "xy" for a in axes])


def moments(tr: DataFrame, by: list[str], axes: list[str], extra: list[str] | None = None) -> DataFrame:
    """R2: sums per window: n, x, y, xx, xy, yy as arrays (row-major); windows with d + 1 transitions or more."""
    x, y = [F.col(f"x_{a}") for a in axes], [F.col(f"y_{a}") for a in axes]
    s = lambda p, q: F.array(*[F.sum(a * b) for a in p for b in q])
    out = tr.groupBy(*by, "window", "center", *(extra or [])).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(a) for a in x]).alias("sx"), F.array(*[F.sum(a) for a in y]).alias("sy"), s(x, x).alias("xx"), s(x, y).alias("xy"), s(y, y).alias("yy"))
    return out if extra else out.where(F.col("n") >= len(axes) + 1)


ALPHAS, FOLDS = (1e-4, 1e-3, 1e-2, 1e-1), 5


def fold_moments(tr: DataFrame, by: list[str], axes: list[str], folds: int = FOLDS) -> DataFrame:
    """(by, window, center, n, cells): moment sums of each contiguous fold of a window's transitions.

    Folds are as even as they can be, the larger ones first; cells holds (fold, n, x, y, xx, xy, yy) of each fold, one
    after another, which is bounded by ``folds``. Windows with d + 1 transitions or more.
    """
    keys = [*by, "window", "center"]
    w = Window.partitionBy(*keys)
    n, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("source")) - 1
    t = tr.withColumns({"__n": n, "__i": i}).withColumns({"__q": F.floor(F.col("__n") / folds), "__r": F.col("__n") % folds})
    head = F.col("__r") * (F.col("__q") + 1)
    fold = F.when(F.col("__i") < head, F.floor(F.col("__i") / (F.col("__q") + 1))).otherwise(F.floor((F.col("__i") - head) / F.greatest("__q", F.lit(1))) + F.col("__r"))
    per = moments(t.withColumn("fold", fold.cast("int")), by, axes, ["fold"])
    cell = F.concat(F.array(F.col("fold").cast("double"), F.col("n").cast("double")), "sx", "sy", "xx", "xy", "yy")
    rows = per.groupBy(*keys).agg(F.sum("n").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("fold", cell.alias("c")))), lambda s: s["c"])).alias("cells"))
    return rows.where(F.col("n") >= len(axes) + 1)


def _cells(part: pd.DataFrame, d: int, folds: int = FOLDS):
    """Stacked sums (windows, folds, ...): n, x, y, xx, xy, yy."""
    length = 2 + 2 * d + 3 * d * d
    flat = np.concatenate([np.asarray(c, float) for c in part["cells"]]).reshape(-1, length)
    owner = np.repeat(np.arange(len(part)), [len(c) // length for c in part["cells"]])
    s = np.zeros((len(part), folds, length - 1))
    s[owner, flat[:, 0].astype(int)] = flat[:, 1:]
    at = np.cumsum([0, 1, d, d, d * d, d * d, d * d])
    n, *rest = [s[..., a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return [n[..., 0], *[x.reshape(*x.shape[:2], *((d, d) if x.shape[-1] == d * d and i >= 2 else (d,))) for i, x in enumerate(rest)]]


def _chosen_alpha(cells, alphas=ALPHAS) -> tuple[np.ndarray, np.ndarray]:
    """The alpha with the best mean R2 over held-out folds, and that R2; the first one where a fold has under two rows."""
    folds = cells[0].shape[1]
    own = [c.reshape(-1, *c.shape[2:]) for c in cells]
    rest = [(c.sum(1, keepdims=True) - c).reshape(-1, *c.shape[2:]) for c in cells]
    n, sx, sy, xx, xy, yy = own
    total = np.einsum("wii->wi", yy) - sy**2 / np.maximum(n, 1)[:, None]
    scores = []
    for alpha in alphas:
        safe = np.maximum(rest[0], 1)
        a, b, *_ = _ridge(safe, *rest[1:], np.full(len(n), alpha))
        # squared error of the held-out fold from its own sums
        err = np.einsum("wii->wi", yy) - 2 * np.einsum("wij,wji->wi", a, xy) - 2 * b * sy + np.einsum("wij,wjk,wik->wi", a, xx, a) + 2 * b * np.einsum("wij,wj->wi", a, sx) + n[:, None] * b**2
        flat = total <= 1e-12 * np.maximum(np.einsum("wii->wi", yy), 1e-300)
        r2 = np.where(flat, np.where(err <= 1e-12, 1.0, 0.0), 1 - err / np.where(flat, 1, total))
        scores.append(r2.mean(1).reshape(-1, folds).mean(1))
    scores = np.stack(scores, 1)
    few = cells[0].min(1) < 2
    best = np.where(few, 0, scores.argmax(1))
    return np.asarray(alphas)[best], np.where(few, np.nan, scores[np.arange(len(best)), best])


def _ridge(n, sx, sy, xx, xy, yy, alpha):
    """A, b, centred Sxx, Sxy, Syy of y = A x + b for stacked moment sums."""
    mx, my = sx / n[:, None], sy / n[:, None]
    cxx = xx - n[:, None, None] * mx[:, :, None] * mx[:, None, :]
    cxy = xy - n[:, None, None] * mx[:, :, None] * my[:, None, :]
    cyy = yy - n[:, None, None] * my[:, :, None] * my[:, None, :]
    a = np.linalg.solve(cxx + np.asarray(alpha).reshape(-1, 1, 1) * np.eye(xx.shape[-1]), cxy).transpose(0, 2, 1)
    return a, my - np.einsum("wij,wj->wi", a, mx), cxx, cxy, cyy


def _residual_scatter(a, cxx, cxy, cyy):
    ay = a @ cxy
    return cyy - ay - ay.transpose(0, 2, 1) + a @ cxx @ a.transpose(0, 2, 1)


def local_models(cells: DataFrame, by: list[str], by_types: str, d: int, covariance: str = "empirical", jitter: float = 1e-8, alphas=ALPHAS) -> DataFrame:
    """N, alpha (chosen by the folds), a (d*d), b (d), q (d*d, residual covariance) and r2 of every window.

    ``cells`` is what ``fold_moments`` gives; r2 is one minus all squared residuals over all squared deviations.
    ``covariance``: "empirical" (ddof 1, + jitter I) or "oas" (shrunk towards the mean variance; both follow from the
    moment sums).
    """
    keys = [*by, "window", "center"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            stack = _cells(part, d)
            alpha, _ = _chosen_alpha(stack, alphas)
            n, *sums = [c.sum(1) for c in stack]
            a, b, cxx, cxy, cyy = _ridge(n, *sums, alpha)
            res = _residual_scatter(a, cxx, cxy, cyy)
            if covariance == "oas":
                emp = res / n[:, None, None]
                mu, tr2 = np.trace(emp, axis1=1, axis2=2) / d, (emp**2).mean((1, 2))
                shrink = np.minimum((tr2 + mu**2) / np.maximum((n + 1) * (tr2 - mu**2 / d), 1e-300), 1)[:, None, None]
                q = (1 - shrink) * emp + shrink * mu[:, None, None] * np.eye(d)
            else:
                q = res / np.maximum(n - 1, 1)[:, None, None]
            q = q + jitter * np.eye(d)
            r2 = 1 - np.trace(res, axis1=1, axis2=2) / (np.trace(cyy, axis1=1, axis2=2) + 1e-10)
            yield part[keys].assign(n=n.astype(int), alpha=alpha, a=list(a.reshape(len(part), -1)), b=list(b), q=list(q.reshape(len(part), -1)), r2=r2)

    return cells.mapInPandas(run, f"{by_types}, window long, center long, n long, alpha double, a array<double>, b array<double>, q array<double>, r2 double")


def choose_alpha(cells: DataFrame, by: list[str], by_types: str, d: int, alphas=ALPHAS) -> DataFrame:
    """Per window the alpha that its folds choose, and its mean held-out R2 (null where folds are too small)."""
    keys = [*by, "window", "center"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                alpha, score = _chosen_alpha(_cells(part, d), alphas)
                yield part[keys].assign(alpha=alpha, cv_r2=score)

    out = cells.mapInPandas(run, f"{by_types}, window long, center long, alpha double, cv_r2 double")
    return out.withColumn("cv_r2", F.nanvl("cv_r2", F.lit(None).cast("double")))


CONE = ["log_det", "kappa", "log_eig_var", "d_eff", "dir_entropy", "dir_entropy_norm", "q_ratio"]


def cones(models: DataFrame, by: list[str], by_types: str, d: int, horizon: int = 4, sigma0: float = 1e-3, jitter: float = 1e-8) -> DataFrame:
    """A row per window and horizon: metrics of the propagated covariance, rotation, operator norm, health."""
    keys = [*by, "window", "center"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            part = part.reset_index(drop=True)
            a, q = (np.concatenate(part[c].to_numpy()).reshape(-1, d, d) for c in ("a", "q"))
            u, s, vt = np.linalg.svd(a)
            polar = u @ vt
            rotation = np.linalg.norm((polar - polar.transpose(0, 2, 1)) / 2, axis=(1, 2))
            sigma = np.broadcast_to(np.eye(d) * sigma0**2, a.shape)
            out = []
            for h in range(1, horizon + 1):
                moved = a @ sigma @ a.transpose(0, 2, 1)
                sigma = moved + q + np.eye(d) * jitter
                sign, ld = np.linalg.slogdet(sigma + np.eye(d) * EPS)
                raw = np.linalg.eigvalsh(sigma)
                e = np.clip(raw, EPS, None)
                p = e / (e.sum(1, keepdims=True) + EPS)
                entropy = -(p * np.log(p + EPS)).sum(1)
                tr = np.trace(sigma, axis1=1, axis2=2)
                out.append(part[keys].assign(
                    h=h, log_det=np.where(sign > 0, 0.5 * ld, np.nan), kappa=e[:, -1] / (e[:, 0] + EPS), log_eig_var=np.log(e + EPS).var(1), d_eff=e.sum(1) ** 2 / ((e**2).sum(1) + EPS),
                    dir_entropy=entropy, dir_entropy_norm=entropy / (np.log(d) + EPS), q_ratio=(tr - np.trace(moved, axis1=1, axis2=2)) / np.maximum(tr, 1e-300), tube_rotation=rotation, tube_a_operator_norm=s[:, 0],
                    near_singular=raw[:, 0] <= 10 * jitter, cond=raw[:, -1] / np.maximum(raw[:, 0], EPS), min_eig_over_median_eig=raw[:, 0] / np.maximum(np.median(raw, axis=1), EPS),
                ))
            yield pd.concat(out)

    return models.mapInPandas(run, f"{by_types}, window long, center long, h int, " + ", ".join(f"{c} double" for c in [*CONE, "tube_rotation", "tube_a_operator_norm"]) + ", near_singular boolean, cond double, min_eig_over_median_eig double")


def tubes(cone: DataFrame, by: list[str]) -> DataFrame:
    """Per window the median of each metric over horizons, q-ratio at horizon 4 (or the last before it), and the capture gate."""
    keys = [*by, "window", "center"]
    at_4 = F.max_by("q_ratio", F.when(F.col("h") <= 4, F.col("h")))
    out = cone.groupBy(*keys).agg(*[F.median(c).alias(f"tube_{c}") for c in CONE], F.max("tube_rotation").alias("tube_rotation"), F.max("tube_a_operator_norm").alias("tube_a_operator_norm"), at_4.alias("tube_q_ratio_h4"))
    return out.withColumn("tube_capture_gate", (1 - F.col("tube_q_ratio_h4")) * F.log1p("tube_a_operator_norm"))


def health(cone: DataFrame, by: list[str]) -> DataFrame:
    """Share of near-singular covariances, medians of condition and of smallest over median eigenvalue."""
    return cone.groupBy(*by).agg(F.avg(F.col("near_singular").cast("double")).alias("near_singular_rate"), F.median("cond").alias("median_cond"), F.median("min_eig_over_median_eig").alias("median_min_eig_over_median_eig"))


def prediction_error(df: DataFrame, models: DataFrame, by: list[str], axes: list[str], horizon: int = 4, index: str = "t_idx") -> DataFrame:
    """Median error of iterating A x + b from each window's centre, by horizon; the recursion is in columns."""
    d = len(axes)
    start = df.select(*by, F.col(index).alias("center"), F.array(*axes).alias("p"))
    state, out = models.select(*by, "window", "center", "a", "b").join(start, [*by, "center"]), None
    for h in range(1, horizon + 1):
        step = F.array(*[sum((F.col("a")[i * d + j] * F.col("p")[j] for j in range(d)), F.col("b")[i]) for i in range(d)])
        state = state.withColumn("p", step)
        real = df.select(*by, (F.col(index) - h).alias("center"), F.array(*axes).alias("x"))
        err = F.sqrt(sum(((F.col("x")[i] - F.col("p")[i]) ** 2 for i in range(d)), F.lit(0.0)))
        e = state.join(real, [*by, "center"]).select(*by, F.lit(h).alias("h"), err.alias("err"))
        out = e if out is None else out.unionByName(e)
    return out.groupBy(*by).pivot("h", list(range(1, horizon + 1))).agg(F.median("err")).select(*by, *[F.col(str(h)).alias(f"pred_err_h{h}") for h in range(1, horizon + 1)])


PERSISTENT = ["log_det", "kappa", "log_eig_var", "d_eff"]


def persistence(tube: DataFrame, by: list[str], index: str = "window", time: str | None = None, width: int = 11, baseline: float = 0.5, low: float = 0.8, back: float = 0.9) -> DataFrame:
    """R11 with W15-W19: medians by key of stability, return time, hysteresis and growth of tube metrics, and split halves.

    All four metrics share one order of windows; with ``time`` (a column of ``tube``) return times and hysteresis are in its unit.
    """
    base = tube.select(*by, index, *([time] if time else []), *[f"tube_{c}" for c in PERSISTENT])
    d = growth_ratio(base, by, "tube_log_det", index).withColumnRenamed("growth", "cone_kappa")
    d = with_hysteresis(d, by, {f"tube_{c}": f"persistence_hysteresis_{c}" for c in PERSISTENT}, width, index, time)
    for c in PERSISTENT:
        d = rolling_stability(d, by, f"tube_{c}", width, 1e-10, index).withColumnRenamed("stability", f"persistence_{c}")
    at = F.col(time or index)
    m = base.groupBy(*by).agg(*[F.percentile(f"tube_{c}", F.lit(baseline)).alias(f"__m_{c}") for c in PERSISTENT])
    later = Window.partitionBy(*by).orderBy(F.desc(index)).rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(m, by)
    for c in PERSISTENT:  # as return_time, for all metrics in one order
        v, level = F.col(f"tube_{c}"), F.col(f"__m_{c}")
        after = F.min(F.when(v >= back * level, F.struct(F.col(index).alias("i"), at.alias("t")))).over(later)
        d = d.withColumn(f"persistence_tau_{c}", F.when(v < low * level, after["t"] - at))
    names = [*[f"persistence_{c}" for c in PERSISTENT], *[f"persistence_tau_{c}" for c in PERSISTENT], *[f"persistence_hysteresis_{c}" for c in PERSISTENT]]
    out = d.groupBy(*by).agg(F.median("cone_kappa").alias("cone_kappa_median"), F.avg("cone_kappa").alias("cone_kappa_mean"), *[F.median(c).alias(f"{c}_median") for c in names])
    for c in ("log_det", "d_eff"):
        halves = split_half(base, by, f"tube_{c}", index)
        out = out.join(halves.select(*by, *[F.col(n).alias(f"tube_{c}_split_half_{n}") for n in ("a_median", "b_median", "rho", "n")]), by, "left")
    return out


def summary(
    df: DataFrame, by: list[str], by_types: str, axes: list[str], k: int = 20, index: str = "t_idx", horizon: int = 4, time: str | None = None, alphas=ALPHAS, covariance: str = "empirical",
    sigma0: float = 1e-3, jitter: float = 1e-8, width: int = 11, baseline: float = 0.5, low: float = 0.8, back: float = 0.9,
) -> DataFrame:
    """One row per key (session, session and stage, or session and network) with all of the above.

    Columns have the names that D2, D5 and R14 go by. ``time`` is a column of ``df``: a window has that of its own index.
    Models and tubes are written once; every branch reads those tables.
    """
    cells = fold_moments(transitions(df, by, axes, k, index), by, axes)
    models = written(local_models(cells, by, by_types, len(axes), covariance, jitter, alphas))
    cone = cones(models, by, by_types, len(axes), horizon, sigma0, jitter)
    tube = tubes(cone, by)
    if time:
        tube = tube.join(df.select(*by, F.col(index).alias("window"), time), [*by, "window"], "left")
    tube = written(tube)
    of_tube = [*[f"tube_{c}" for c in CONE if c != "q_ratio"], "tube_rotation", "tube_q_ratio_h4", "tube_a_operator_norm", "tube_capture_gate"]
    out = tube.groupBy(*by).agg(F.count(F.lit(1)).alias("n_windows"), *[f for c in of_tube for f in (F.median(c).alias(f"{c}_median"), F.avg(c).alias(f"{c}_mean"))])
    each = cone.groupBy(*by, "h").agg(*[F.median(c).alias(c) for c in CONE])
    at = lambda c, h: F.max(F.when(F.col("h") == h, F.col(c)))
    each = each.groupBy(*by).agg(*[at(c, h).alias(f"cone_{c}_h{h}_median") for c in CONE for h in range(1, horizon + 1)], *[at("q_ratio", h).alias(f"q_ratio_h{h}_median") for h in range(1, horizon + 1)])
    fit = models.groupBy(*by).agg(F.median("r2").alias("r2_median"), F.median("n").alias("n_median"), F.median("alpha").alias("alpha_median"))
    out = out.withColumn("dims", F.lit(len(axes))).withColumn("horizon", F.lit(horizon)).withColumn("k", F.lit(k))
    for part in (each, fit, health(cone, by), persistence(tube, by, "window", time, width, baseline, low, back)):
        out = out.join(part, by)
    return out.join(prediction_error(df, models, by, axes, horizon, index), by, "left")


def shape_indices(df: DataFrame) -> DataFrame:
    """Ovality, elongation (log10 of kappa, at least 1), compactness (0 to 1), likeness and size.

    The last horizon is found from the column names cone_kappa_h<n>_median.
    """
    last = max(int(c[len("cone_kappa_h") : -len("_median")]) for c in df.columns if c.startswith("cone_kappa_h") and c.endswith("_median"))
    log = lambda c: F.log10(F.greatest(F.col(c), F.lit(1.0)))
    share = lambda c: F.least(F.greatest(F.col(c) / F.greatest(F.col("dims"), F.lit(1)), F.lit(0.0)), F.lit(1.0))
    out = df.withColumns({"endpoint_ovality": log(f"cone_kappa_h{last}_median"), "tube_elongation": log("tube_kappa_median"), "tube_compactness": share("tube_d_eff_median"), "size": F.col("tube_log_det_median")})
    return out.withColumn("tube_likeness", F.col("tube_elongation") * (1 - F.col("tube_compactness")))
