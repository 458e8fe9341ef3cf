"""Small matrices in array columns (row-major): invariants as expressions, spectra as row-batched numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def el(j: str, d: int, r: int, c: int) -> Column:
    return F.col(j)[r * d + c]


def total(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def invariants(df: DataFrame, d: int, j: str = "j") -> DataFrame:
    """M1: trace, Frobenius norm, norms of the antisymmetric and symmetric parts, sum of absolute diagonal."""
    cells = [(r, c) for r in range(d) for c in range(d)]
    part = lambda s: F.sqrt(total([((el(j, d, r, c) + s * el(j, d, c, r)) / 2) ** 2 for r, c in cells]))
    return df.withColumns({
        "trace": total([el(j, d, r, r) for r in range(d)]), "fro": F.sqrt(total([el(j, d, r, c) ** 2 for r, c in cells])),
        "antisym": part(-1), "sym": part(1), "diag_abs": total([F.abs(el(j, d, r, r)) for r in range(d)]),
    })


def spectra(df: DataFrame, keys: list[str], key_types: str, d: int, j: str = "j") -> DataFrame:
    """M2-M4: singular and eigenvalue metrics of each row's matrix, decomposed as one stack per Arrow batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.reset_index(drop=True)
            m = np.array(part[j].tolist(), float).reshape(-1, d, d) if len(part) else np.zeros((0, d, d))
            s = np.linalg.svd(m, compute_uv=False)
            v = np.linalg.eigvals(m)
            size = np.abs(v)
            yield part[keys].assign(
                op_norm=s[:, 0], aci=s[:, 0] / (s[:, 1:3].sum(1) + 1e-12), cond=np.where(s[:, -1] > 0, s[:, 0] / np.maximum(s[:, -1], 1e-300), np.inf), eig_var=size.var(1), eig_max=size.max(1),
                rotational=np.abs(v.imag).mean(1), re_max=v.real.max(1), re_min=v.real.min(1), im_max=np.abs(v.imag).max(1),
            )

    names = "op_norm aci cond eig_var eig_max rotational re_max re_min im_max".split()
    return df.select(*keys, j).mapInPandas(run, key_types + ", " + ", ".join(f"{n} double" for n in names))


def condition_summary(spec: DataFrame, by: list[str], singular: float = 1e8) -> DataFrame:
    """M4: median, IQR and MAD of the condition number, share above ``singular``."""
    from tideline.operators.aggregates import spread

    rate = spec.groupBy(*by).agg(F.avg((F.col("cond") > singular).cast("double")).alias("singular_rate"))
    return spread(spec, by, "cond").select(*by, "median", "iqr", "mad").join(rate, by)


def change_rate(df: DataFrame, by: list[str], d: int, index: str = "t_idx", j: str = "j") -> DataFrame:
    """M5: |J_dot| / (|J| + 1e-12) with J_dot by central differences."""
    from tideline.operators.sequences import central_difference

    cells = [f"__j{k}" for k in range(d * d)]
    flat = central_difference(df.withColumns({c: F.col(j)[k] for k, c in enumerate(cells)}), by, cells, index)
    norm = lambda s: F.sqrt(total([F.col(c + s) ** 2 for c in cells]))
    return flat.withColumn("mdr", norm("_dot") / (norm("") + 1e-12)).drop(*cells, *[f"{c}_dot" for c in cells])


def rotation_coherence(df: DataFrame, by: list[str], j: str = "j") -> DataFrame:
    """M6: length of the mean unit rotation axis of 3x3 matrices."""
    axis = [(el(j, 3, 2, 1) - el(j, 3, 1, 2)) / 2, (el(j, 3, 0, 2) - el(j, 3, 2, 0)) / 2, (el(j, 3, 1, 0) - el(j, 3, 0, 1)) / 2]
    size = F.sqrt(total([a * a for a in axis]))
    mean = [F.avg(F.when(size > 1e-12, a / size)) for a in axis]
    return df.groupBy(*by).agg(F.sqrt(total([m * m for m in mean])).alias("coherence"))


def matrix_summary(df: DataFrame, by: list[str], by_types: str, d: int, index: str = "t_idx", index_type: str = "long", with_dot: bool = True) -> DataFrame:
    """M7-M9: mean and median by key of the invariants, spectra and change rate of each window's matrix."""
    rows = change_rate(df, by, d, index) if with_dot else df.withColumn("mdr", F.lit(None).cast("double"))
    keys = [*by, index]
    both = invariants(rows, d).drop("j").join(spectra(df, keys, f"{by_types}, {index} {index_type}", d), keys)
    names = ["trace", "fro", "antisym", "sym", "mdr", "op_norm", "aci", "cond", "eig_var", "eig_max", "rotational"]
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n_windows"), *[f(n).alias(f"{n}_{s}") for n in names for s, f in (("mean", F.avg), ("median", F.median))])


def with_matrices(rows: DataFrame, matrices: DataFrame, by: list[str], by_types: str, d: int, index: str = "t_idx", index_type: str = "long") -> DataFrame:
    """Adds median, IQR and MAD of the condition number and the rotation coherence of each key's matrices."""
    keys = [*by, index]
    cond = condition_summary(spectra(matrices, keys, f"{by_types}, {index} {index_type}", d), by)
    out = rows.join(cond.select(*by, *[F.col(c).alias(f"tier2_jacobian_condition_number_{c}") for c in ("median", "iqr", "mad")]), by, "left")
    return out.join(rotation_coherence(matrices, by).withColumnRenamed("coherence", "tier2_jacobian_rotation_coherence_mrl"), by, "left")


def flow_metrics(df: DataFrame, d: int, eps: float = 1e-12) -> DataFrame:
    """Rotational power rot^2 / (fro^2 + eps), ratio antisymmetric to symmetric, sum |diag| / fro; inf is null."""
    i = invariants(df, d)
    return i.withColumns({
        "rotational_power": F.col("antisym") ** 2 / (F.col("fro") ** 2 + eps), "anti_sym_ratio": F.when(F.col("sym") > 0, F.col("antisym") / F.col("sym")), "diag_share": F.when(F.col("fro") > 0, F.col("diag_abs") / F.col("fro")),
    })


def phase_volume(df: DataFrame, d: int, axes: list[str], j: str = "j") -> DataFrame:
    """Expansion of volume (trace), along the flow v'Sv / |v|^2, and across it; slow flow (< 1e-10): nulls."""
    v = [F.col(a) for a in axes]
    speed2 = total([x * x for x in v])
    along = total([v[r] * (el(j, d, r, c) + el(j, d, c, r)) / 2 * v[c] for r in range(d) for c in range(d)]) / speed2
    trace = total([el(j, d, r, r) for r in range(d)])
    moving = F.sqrt(speed2) >= 1e-10
    return df.withColumns({"expansion": trace, "along_flow": F.when(moving, along), "across_flow": F.when(moving, trace - along)})


def transverse(df: DataFrame, keys: list[str], key_types: str, d: int, axes: list[str], j: str = "j") -> DataFrame:
    """Largest eigenvalue and positive sum of the symmetric part in the complement of the flow."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.reset_index(drop=True)
            if not len(part):
                continue
            m = np.concatenate(part[j].to_numpy()).reshape(-1, d, d)
            v = part[axes].to_numpy(float)
            size = np.linalg.norm(v, axis=1, keepdims=True)
            u = v / np.maximum(size, 1e-300)
            p = np.eye(d) - u[:, :, None] * u[:, None, :]
            e = np.linalg.eigvalsh(p @ ((m + m.transpose(0, 2, 1)) / 2) @ p)
            flow = np.argmin(np.abs(e), axis=1)  # the projected direction has eigenvalue 0
            rest = e[np.arange(d) != flow[:, None]].reshape(-1, d - 1)
            ok = (size[:, 0] >= 1e-10)
            yield part[keys].assign(top=np.where(ok, rest.max(1), np.nan), positive_sum=np.where(ok, np.maximum(rest, 0).sum(1), np.nan))

    return df.select(*keys, *axes, j).mapInPandas(run, key_types + ", top double, positive_sum double")


def coupling(df: DataFrame, ax: str, xa: str, raw: str, kept: str, least: float = 0.5) -> DataFrame:
    """Frobenius norms of both coupling blocks, retained share and whether that is enough."""
    fro = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    out = df.withColumns({"drive_ax": fro(ax), "drive_xa": fro(xa), "retention": F.when(F.col(raw) > 0, F.col(kept) / F.col(raw))})
    return out.withColumn("usable", F.coalesce(F.col("retention") >= least, F.lit(False)))


def standardise(df: DataFrame, by: list[str], columns: list[str], how: str) -> DataFrame:
    """None, robust ((x - median) / MAD) or z; a constant column becomes 0."""
    if how == "none":
        return df
    if how == "z":
        s = df.groupBy(*by).agg(*[f(c).alias(f"__{n}{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    else:
        m = df.groupBy(*by).agg(*[F.median(c).alias(f"__m{c}") for c in columns])
        s = m.join(df.join(m, by).groupBy(*by).agg(*[F.median(F.abs(F.col(c) - F.col(f"__m{c}"))).alias(f"__s{c}") for c in columns]), by)
    out = df.join(s, by)
    z = {c: F.when(F.col(f"__s{c}") > 1e-12, (F.col(c) - F.col(f"__m{c}")) / F.col(f"__s{c}")).otherwise(0.0) for c in columns}
    return out.withColumns(z).drop(*[f"__{n}{c}" for c in columns for n in "ms"])


def principal_components(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The first k principal components (pc0, ...) by Spark ML."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=columns, outputCol="__v").transform(df)
    out = PCA(k=k, inputCol="__v", outputCol="__p").fit(rows).transform(rows)
    return out.withColumns({f"pc{i}": vector_to_array("__p")[i] for i in range(k)}).drop("__v", "__p")


def occupancy_volume(df: DataFrame, by: list[str], axes: list[str], eps: float = 1e-9) -> DataFrame:
    """Log-determinant of the (sample) covariance + eps I of three axes."""
    cov = df.groupBy(*by).agg(*[F.covar_samp(a, b).alias(f"__{i}{j}") for i, a in enumerate(axes) for j, b in enumerate(axes) if i <= j])
    g = lambda i, j: F.col(f"__{min(i, j)}{max(i, j)}") + (eps if i == j else 0)
    det = g(0, 0) * (g(1, 1) * g(2, 2) - g(1, 2) * g(1, 2)) - g(0, 1) * (g(0, 1) * g(2, 2) - g(1, 2) * g(0, 2)) + g(0, 2) * (g(0, 1) * g(1, 2) - g(1, 1) * g(0, 2))
    return cov.select(*by, F.log(det).alias("log_det"))


def covariance_kappa(df: DataFrame, by: list[str], by_types: str, axes: list[str], eps: float = 1e-9) -> DataFrame:
    """Largest over smallest (+ eps) eigenvalue of the covariance."""
    cells = F.array(*[F.covar_samp(a, b) for a in axes for b in axes])
    rows = df.groupBy(*by).agg(cells.alias("j"))
    d = len(axes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.reset_index(drop=True)
            e = np.linalg.eigvalsh(np.array(part["j"].tolist(), float).reshape(-1, d, d))
            yield part[by].assign(kappa=e[:, -1] / (e[:, 0] + eps))

    return rows.mapInPandas(run, by_types + ", kappa double")
