"""Queries of the matrix operators: each embedding's first nine values are a 3x3 matrix."""

from pyspark.sql import functions as F

from tideline.operators import matrices as op
from tideline.plans.registry import query
from tideline.plans.shapes import TRAJECTORY, r6, trajectory

TYPES = "session int, t_idx long"


def mats(spark, d):
    return trajectory(spark, d).withColumn("j", F.array(*[F.col(f"x{i}") for i in range(9)]))


INV = TRAJECTORY + """, iv AS (SELECT session, t_idx, x0 + x4 + x8 AS trace, sqrt(x0*x0+x1*x1+x2*x2+x3*x3+x4*x4+x5*x5+x6*x6+x7*x7+x8*x8) AS fro, sqrt(2 * (((x1-x3)/2)**2 + ((x2-x6)/2)**2 + ((x5-x7)/2)**2)) AS antisym,
 sqrt(x0*x0 + x4*x4 + x8*x8 + 2 * (((x1+x3)/2)**2 + ((x2+x6)/2)**2 + ((x5+x7)/2)**2)) AS sym, abs(x0) + abs(x4) + abs(x8) AS diag_abs FROM tr)"""


@query("m1_invariants", "WITH " + INV + " SELECT session, t_idx, round(trace, 6) AS trace, round(fro, 6) AS fro, round(antisym, 6) AS antisym, round(sym, 6) AS sym, round(diag_abs, 6) AS diag_abs FROM iv")
def m1(spark, d):
    return r6(op.invariants(mats(spark, d), 3).select("session", "t_idx", "trace", "fro", "antisym", "sym", "diag_abs"))


@query("m2_m3_spectra")
def m2(spark, d):
    return r6(op.spectra(mats(spark, d), ["session", "t_idx"], TYPES, 3))


@query("m4_condition")
def m4(spark, d):
    return r6(op.condition_summary(op.spectra(mats(spark, d), ["session", "t_idx"], TYPES, 3), ["session"]))


O = "OVER (PARTITION BY session ORDER BY t_idx)"
DOT = ", ".join(f"coalesce((lead(x{i}) {O} - lag(x{i}) {O}) / 2, lead(x{i}) {O} - x{i}, x{i} - lag(x{i}) {O}, 0) AS y{i}" for i in range(9))


@query("m5_change_rate", "WITH " + INV + f", dt AS (SELECT session, t_idx, {DOT} FROM tr) SELECT session, t_idx, round(sqrt({' + '.join(f'y{i}*y{i}' for i in range(9))}) / (fro + 1e-12), 6) AS mdr FROM dt JOIN iv USING (session, t_idx)")
def m5(spark, d):
    return r6(op.change_rate(mats(spark, d), ["session"], 3).select("session", "t_idx", "mdr"))


@query("m6_rotation_coherence", "WITH " + TRAJECTORY + ", ax AS (SELECT session, (x7 - x5) / 2 AS a, (x2 - x6) / 2 AS b, (x3 - x1) / 2 AS c FROM tr) SELECT session, round(sqrt(avg(a / s)**2 + avg(b / s)**2 + avg(c / s)**2), 6) AS coherence FROM (SELECT *, sqrt(a*a + b*b + c*c) AS s FROM ax) WHERE s > 1e-12 GROUP BY session")
def m6(spark, d):
    return r6(op.rotation_coherence(mats(spark, d), ["session"]))


@query("m7_jacobian_summary")
def m7(spark, d):
    return r6(op.matrix_summary(mats(spark, d).select("session", "t_idx", "j"), ["session"], "session int", 3))


@query("m8_stage_jacobian")
def m8(spark, d):
    staged = mats(spark, d).select("session", (F.floor(F.col("t_idx") / 10).cast("int") % 3).alias("stage"), "t_idx", "j")
    return r6(op.matrix_summary(staged, ["session", "stage"], "session int, stage int", 3))


@query("m9_regional_jacobian")
def m9(spark, d):
    regional = mats(spark, d).select("session", (F.col("t_idx") % 2).cast("int").alias("network"), "t_idx", "j")
    return r6(op.matrix_summary(regional, ["session", "network"], "session int, network int", 3, with_dot=False).drop("mdr_mean", "mdr_median"))


@query("m10_flow_metrics", "WITH " + INV + " SELECT session, t_idx, round(antisym**2 / (fro**2 + 1e-12), 6) AS rotational_power, round(antisym / sym, 6) AS anti_sym_ratio, round(diag_abs / fro, 6) AS diag_share FROM iv")
def m10(spark, d):
    return r6(op.flow_metrics(mats(spark, d), 3).select("session", "t_idx", "rotational_power", "anti_sym_ratio", "diag_share"))


@query("m10_flow_summary", "WITH " + INV + ", fm AS (SELECT session, antisym**2 / (fro**2 + 1e-12) AS r, diag_abs / fro AS s FROM iv) SELECT session, round(median(r), 6) AS rotational_power, round(quantile_cont(r, 0.75) - quantile_cont(r, 0.25), 6) AS rotational_iqr, round(median(s), 6) AS diag_share FROM fm GROUP BY session")
def m10b(spark, d):
    q = lambda p: F.percentile("rotational_power", F.lit(p))
    return r6(op.flow_metrics(mats(spark, d), 3).groupBy("session").agg(F.median("rotational_power").alias("rotational_power"), (q(0.75) - q(0.25)).alias("rotational_iqr"), F.median("diag_share").alias("diag_share")))


@query("m11_phase_volume", "WITH " + TRAJECTORY + """ SELECT session, t_idx, round(x0 + x4 + x8, 6) AS expansion, round(f, 6) AS along_flow, round(x0 + x4 + x8 - f, 6) AS across_flow FROM (SELECT *, (m*m*x0 + d*d*x4 + e*e*x8 + m*d*(x1+x3) + m*e*(x2+x6) + d*e*(x5+x7)) / (m*m + d*d + e*e) AS f FROM tr)""")
def m11(spark, d):
    return r6(op.phase_volume(mats(spark, d), 3, ["m", "d", "e"]).select("session", "t_idx", "expansion", "along_flow", "across_flow"))


@query("m11_transverse")
def m11b(spark, d):
    return r6(op.transverse(mats(spark, d), ["session", "t_idx"], TYPES, 3, ["m", "d", "e"]))


@query("m12_coupling", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding[1:15], lambda x: x::DOUBLE * x::DOUBLE))), 6) AS drive_ax, round(sqrt(list_sum(list_transform(embedding[16:30], lambda x: x::DOUBLE * x::DOUBLE))), 6) AS drive_xa, round((vec_id % 40) / 50.0::DOUBLE, 6) AS retention, (vec_id % 40) / 50.0::DOUBLE >= 0.5 AS usable FROM embeddings")
def m12(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    e = e.select("vec_id", F.slice("embedding", 1, 15).cast("array<double>").alias("ax"), F.slice("embedding", 16, 15).cast("array<double>").alias("xa"), F.lit(50).alias("raw"), (F.col("vec_id") % 40).alias("kept"))
    return r6(op.coupling(e, "ax", "xa", "raw", "kept").select("vec_id", "drive_ax", "drive_xa", "retention", "usable"))


@query("m13_standardise", "WITH " + TRAJECTORY + ", s AS (SELECT session, avg(m) AS am, stddev_pop(m) AS sm, median(d) AS md, mad(d) AS sd FROM tr GROUP BY session) SELECT session, t_idx, round((m - am) / sm, 6) AS m, round((d - md) / sd, 6) AS d FROM tr JOIN s USING (session)")
def m13(spark, d):
    t = trajectory(spark, d, 3)
    return r6(op.standardise(op.standardise(t, ["session"], ["m"], "z"), ["session"], ["d"], "robust").select("session", "t_idx", "m", "d"))


@query("m13_pca")
def m13b(spark, d):
    return r6(op.principal_components(trajectory(spark, d), [f"x{i}" for i in range(9)], 3).select("session", "t_idx", *[F.abs(f"pc{i}").alias(f"pc{i}") for i in range(3)]))


C = {k: f"covar_samp({a}, {b})" for k, (a, b) in {"mm": "mm", "dd": "dd", "ee": "ee", "md": "md", "me": "me", "de": "de"}.items()}


@query("m14_occupancy_volume", "WITH " + TRAJECTORY + f", c AS (SELECT session, {', '.join(f'{v} + ' + ('1e-9' if k[0] == k[1] else '0') + f' AS {k}' for k, v in C.items())} FROM tr GROUP BY session) SELECT session, round(ln(mm * (dd * ee - de * de) - md * (md * ee - de * me) + me * (md * de - dd * me)), 6) AS log_det FROM c")
def m14(spark, d):
    return r6(op.occupancy_volume(trajectory(spark, d, 3), ["session"], ["m", "d", "e"]))


@query("m14_covariance_kappa")
def m14b(spark, d):
    return r6(op.covariance_kappa(trajectory(spark, d, 3), ["session"], "session int", ["m", "d", "e"]))
