"""Sliding-window features of multi-channel signals in long form (session, roi, network, t_idx, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators.sequences import curvature, logistic_normalise
from tideline.operators.tiles import pair_sums

#: Short network names in region labels and their canonical names.
NETWORKS = {"Vis": "visual", "SomMot": "somatomotor", "DorsAttn": "dorsal_attention", "SalVentAttn": "salience", "Limbic": "limbic", "Cont": "control", "Default": "default"}


def parse_region(df: DataFrame, name: str) -> DataFrame:
    """Hemisphere, network (canonical; an unknown one stays) and subregion of <atlas>_<hemi>_<net>_<sub>."""
    part = lambda i: F.nullif(F.regexp_extract(name, r"^[^_]+_([^_]+)_([^_]+)_?(.*)$", i), F.lit(""))
    known = F.create_map(*[F.lit(x) for kv in NETWORKS.items() for x in kv])
    return df.withColumn("hemisphere", part(1)).withColumn("network", F.coalesce(F.element_at(known, part(2)), part(2))).withColumn("subregion", part(3))


def coverage(regions: DataFrame, networks: DataFrame) -> DataFrame:
    """Regions in total and by hemisphere for every listed network, 0 when absent."""
    n = regions.groupBy("network").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("hemisphere") == "LH", 1)).alias("lh"), F.count(F.when(F.col("hemisphere") == "RH", 1)).alias("rh"))
    return networks.join(n, "network", "left").fillna(0, ["total", "lh", "rh"])


def network_signal(df: DataFrame) -> DataFrame:
    """Mean and median over a network's regions at each time."""
    return df.groupBy("session", "network", "t_idx").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.count("value").alias("n_rois"))


def first_component(df: DataFrame) -> DataFrame:
    """First principal component over time of each network's regions (sign: the largest loading is positive).

    The covariance is an aggregation over region pairs of a network; only that small matrix goes to numpy.
    """
    key = ["session", "network"]
    centred = df.withColumn("v", F.col("value") - F.avg("value").over(Window.partitionBy(*key, "roi")))
    a, b = centred.select(*key, "t_idx", F.col("roi").alias("i"), F.col("v").alias("a")), centred.select(*key, "t_idx", F.col("roi").alias("j"), F.col("v").alias("b"))
    gram = a.join(b, [*key, "t_idx"]).where("i <= j").groupBy(*key, "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g"))
    rows = gram.groupBy(*key).agg(F.collect_list(F.struct("i", "j", "g")).alias("cells"))  # regions of a network: bounded

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for s, n, cells in part.itertuples(index=False):
                ids = sorted({c["i"] for c in cells})
                at = {r: k for k, r in enumerate(ids)}
                m = np.zeros((len(ids), len(ids)))
                for c in cells:
                    m[at[c["i"]], at[c["j"]]] = m[at[c["j"]], at[c["i"]]] = c["g"]
                v = np.linalg.eigh(m)[1][:, -1]
                v = v * np.sign(v[np.argmax(np.abs(v))] or 1)
                out += [(s, n, r, float(x)) for r, x in zip(ids, v, strict=True)]
            yield pd.DataFrame(out, columns=["session", "network", "roi", "loading"])

    loadings = rows.mapInPandas(run, "session int, network int, roi int, loading double")
    return centred.join(loadings, [*key, "roi"]).groupBy(*key, "t_idx").agg(F.sum(F.col("v") * F.col("loading")).alias("pc1"))


def windows(df: DataFrame, width: int, step: int) -> DataFrame:
    """Every sample once for each full window that covers it; adds win and win_time (in samples)."""
    last = df.groupBy("session").agg(F.max("t_idx").alias("__t"))
    j = df.join(last, "session")
    count = F.floor((F.col("__t") + 1 - width) / step) + 1
    first = F.greatest(F.ceil((F.col("t_idx") - width + 1) / step), F.lit(0))
    to = F.least(F.floor(F.col("t_idx") / step), count - 1)
    return j.withColumn("win", F.explode(F.when(to >= first, F.sequence(first, to)))).withColumn("win_time", F.col("win") * step + width / 2).drop("__t")


def log_variance(win: DataFrame, key: list[str]) -> DataFrame:
    """Mean over regions of ln(variance + 1e-12)."""
    v = win.groupBy(*key, "win", "roi").agg(F.var_pop("value").alias("v"))
    return v.groupBy(*key, "win").agg(F.avg(F.log(F.col("v") + 1e-12)).alias("entropy"))


def mobility(win: DataFrame, key: list[str]) -> DataFrame:
    """Variance of first differences of the region mean."""
    m = win.groupBy(*key, "win", "t_idx").agg(F.avg("value").alias("v"))
    d = m.withColumn("d", F.col("v") - F.lag("v").over(Window.partitionBy(*key, "win").orderBy("t_idx")))
    return d.groupBy(*key, "win").agg(F.var_pop("d").alias("mobility"))


def diffusivity(win: DataFrame, key: list[str]) -> DataFrame:
    """Mean absolute deviation from the region mean at each time; two regions or more."""
    m = win.groupBy(*key, "win", "t_idx").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return win.join(m, [*key, "win", "t_idx"]).groupBy(*key, "win").agg(F.when(F.max("n") >= 2, F.avg(F.abs(F.col("value") - F.col("mean")))).alias("diffusivity"))


def power_modularity(win: DataFrame, key: list[str]) -> DataFrame:
    """Mean square, and mean correlation of different regions by the sum of z-scores (no region pairs)."""
    s = win.groupBy(*key, "win", "roi").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count(F.lit(1)).alias("t"))
    z = win.join(s, [*key, "win", "roi"]).withColumn("z", (F.col("value") - F.col("m")) / F.greatest(F.col("s"), F.lit(1e-12)))
    at = z.groupBy(*key, "win", "t_idx").agg(F.sum("z").alias("zs"), F.sum(F.col("z") ** 2).alias("zz"), F.sum(F.col("value") ** 2).alias("p"), F.count(F.lit(1)).alias("n"))
    n, t = F.max("n"), F.count(F.lit(1))
    return at.groupBy(*key, "win").agg((F.sum("p") / F.sum("n")).alias("power"), F.when(n >= 2, F.sum(F.col("zs") ** 2 - F.col("zz")) / (t * n * (n - 1))).alias("modularity"))


def coordinates(win: DataFrame, key: list[str]) -> DataFrame:
    """Mobility, diffusivity and entropy, each normalised over its key's windows: m, d, e."""
    j = mobility(win, key).join(diffusivity(win, key), [*key, "win"]).join(log_variance(win, key), [*key, "win"]).where("diffusivity is not null")
    j = logistic_normalise(j, key, {"mobility": "m", "diffusivity": "d", "entropy": "e"})
    return j.select(*key, "win", "m", "d", "e")


def project(df: DataFrame, key: list[str], features: list[str], weights: dict[str, dict[str, float]]) -> DataFrame:
    """Weighted sums of normalised features, normalised again by key; one column per axis."""
    df = logistic_normalise(df, key, {f: f"__n_{f}" for f in features})
    for axis, w in weights.items():
        df = df.withColumn(f"__a_{axis}", sum((F.col(f"__n_{f}") * c for f, c in w.items()), F.lit(0.0)))
    df = logistic_normalise(df, key, {f"__a_{axis}": axis for axis in weights})
    return df.drop(*[f"__n_{f}" for f in features], *[f"__a_{a}" for a in weights])


def geometry(df: DataFrame, by: str, index: str, axes: list[str], near: float = 0.1) -> DataFrame:
    """X11: box volume, pair distances, curvature, recurrence rate and mean neighbours within near * largest distance."""
    volume = F.lit(1.0)
    for a in axes:
        volume = volume * (F.max(a) - F.min(a))
    box = df.groupBy(by).agg(volume.alias("volume"), F.count(F.lit(1)).alias("n"))
    far = pair_sums(df, [by], index, axes, near)
    out = box.join(far, by).join(curvature(df, [by], axes, index).drop("n"), by, "left")
    return out.withColumn("recurrence", F.col("close") / F.col("pairs")).withColumn("mean_neighbours", 2 * F.col("close") / F.col("n")).drop("pairs", "close")
