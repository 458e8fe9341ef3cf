"""Queries of the reachability operators."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators import reachability as op
from tideline.operators.sequences import stage_slices, stride
from tideline.plans.registry import query
from tideline.plans.shapes import TRAJECTORY, r6, trajectory

AXES = ["m", "d", "e"]


def points(spark, d):
    return stride(trajectory(spark, d, 3), ["session"]).select("session", "t_idx", *AXES)


def timed(spark, d):
    """The same with the time of each point, which a stride keeps: two seconds a step."""
    return stride(trajectory(spark, d, 3).withColumn("time", F.col("t_idx") * 2.0), ["session"]).select("session", "t_idx", "time", *AXES)


TRANS = TRAJECTORY + """, tn AS (SELECT session, count(*) AS n FROM tr GROUP BY session), pt AS (SELECT session, (t_idx / CASE WHEN n > 2000 THEN ceil(n / 2000)::BIGINT ELSE 1 END)::BIGINT AS t_idx, m, d, e FROM tr JOIN tn USING (session) WHERE t_idx % CASE WHEN n > 2000 THEN ceil(n / 2000)::BIGINT ELSE 1 END = 0),
nb AS (SELECT session, t_idx AS member, nbr AS source FROM (SELECT a.session, a.t_idx, b.t_idx AS nbr, row_number() OVER (PARTITION BY a.session, a.t_idx ORDER BY round((a.m - b.m)**2 + (a.d - b.d)**2 + (a.e - b.e)**2, 9), b.t_idx) AS rk FROM pt a JOIN pt b ON a.session = b.session) WHERE rk <= 8),
ls AS (SELECT session, max(t_idx) AS last FROM pt GROUP BY session), sw AS (SELECT session, win, least(win + 1, last - 1) AS center, unnest(range(win, least(win + 2, last) + 1)) AS member FROM (SELECT session, last, unnest(range(0, greatest(last - 2, 0) + 1)) AS win FROM ls)),
cs AS (SELECT DISTINCT session, win, center, source FROM sw JOIN nb USING (session, member)), tn2 AS (SELECT cs.session, win, center, source, x.m AS xm, x.d AS xd, x.e AS xe, y.m AS ym, y.d AS yd, y.e AS ye FROM cs JOIN pt x ON cs.session = x.session AND cs.source = x.t_idx JOIN pt y ON cs.session = y.session AND y.t_idx = cs.source + 1)"""


@query("r1_transitions", "WITH " + TRANS + ' SELECT session, win AS "window", center, source, round(xm, 6) AS x_m, round(ym, 6) AS y_m FROM tn2')
def r1(spark, d):
    return r6(op.transitions(points(spark, d), ["session"], AXES, 8).select("session", "window", "center", "source", "x_m", "y_m"))


@query("r2_moments", "WITH " + TRANS + ' SELECT session, win AS "window", count(*) AS n, round(sum(xm), 6) AS sx, round(sum(ye), 6) AS sy, round(sum(xm * xd), 6) AS xx, round(sum(xd * ye), 6) AS xy, round(sum(ym * ym), 6) AS yy FROM tn2 GROUP BY ALL HAVING count(*) >= 4')
def r2(spark, d):
    m = op.moments(op.transitions(points(spark, d), ["session"], AXES, 8), ["session"], AXES)
    return r6(m.select("session", "window", "n", F.col("sx")[0].alias("sx"), F.col("sy")[2].alias("sy"), F.col("xx")[1].alias("xx"), F.col("xy")[5].alias("xy"), F.col("yy")[0].alias("yy")))


def _cells(spark, d):
    return op.fold_moments(op.transitions(points(spark, d), ["session"], AXES, 8), ["session"], AXES)


def _models(spark, d, covariance="empirical"):
    return op.local_models(_cells(spark, d), ["session"], "session int", 3, covariance)


def _flat(df, names):
    return df.select(*[c for c in df.columns if c not in names], *[F.col(n)[i].alias(f"{n}{i}") for n, k in names.items() for i in range(k)])


@query("r2_local_models")
def r2b(spark, d):
    return r6(_flat(_models(spark, d), {"a": 9, "b": 3, "q": 9}))


@query("r3_alpha_by_folds")
def r3(spark, d):
    return r6(op.choose_alpha(_cells(spark, d), ["session"], "session int", 3))


@query("r4_residual_covariance")
def r4(spark, d):
    return r6(_flat(_models(spark, d, "oas"), {"q": 9}).drop("a", "b"))


@query("r5_r6_cones")
def r5(spark, d):
    return r6(op.cones(_models(spark, d), ["session"], "session int", 3).drop("cond"))


@query("r7_r8_tubes")
def r7(spark, d):
    return r6(op.tubes(op.cones(_models(spark, d), ["session"], "session int", 3), ["session"]))


@query("r9_prediction_error")
def r9(spark, d):
    return r6(op.prediction_error(points(spark, d), _models(spark, d), ["session"], AXES))


@query("r10_numeric_health")
def r10(spark, d):
    return r6(op.health(op.cones(_models(spark, d), ["session"], "session int", 3), ["session"]))


@query("r11_session_summary")
def r11(spark, d):
    return r6(op.summary(timed(spark, d), ["session"], "session int", AXES, 8, time="time"))


@query("r12_stage_summary")
def r12(spark, d):
    t = trajectory(spark, d, 3).withColumn("stage", F.floor(F.col("t_idx") / 10).cast("int") % 2)
    s = stage_slices(t.withColumn("time", F.col("t_idx") * 2.0), "session", "stage", {0: "n1", 1: "n2"}, 20)
    s = s.withColumn("t_idx", (F.row_number().over(Window.partitionBy("slice").orderBy("t_idx")) - 1).cast("long"))  # kept rows as one sequence
    return r6(op.summary(stride(s, ["slice"]).select("slice", "t_idx", "time", *AXES), ["slice"], "slice string", AXES, 8, time="time"))


@query("r13_network_summary")
def r13(spark, d):
    t = trajectory(spark, d, 9).withColumn("time", F.col("t_idx") * 2.0)
    two = t.select("session", F.lit(0).alias("network"), "t_idx", "time", *AXES).unionByName(t.select("session", F.lit(1).alias("network"), "t_idx", "time", F.col("x3").alias("m"), F.col("x4").alias("d"), F.col("x5").alias("e")))
    return r6(op.summary(stride(two, ["session", "network"]), ["session", "network"], "session int, network int", AXES, 8, time="time"))


@query("r14_shape_indices", """SELECT o_orderkey, round(log10(greatest(o_totalprice / 1000, 1)), 6) AS endpoint_ovality, round(log10(greatest(o_totalprice / 500, 1)), 6) AS tube_elongation, round(least(greatest((o_orderkey % 40) / 10.0::DOUBLE / 3, 0), 1), 6) AS tube_compactness, -o_totalprice AS size,
 round(log10(greatest(o_totalprice / 500, 1)) * (1 - least(greatest((o_orderkey % 40) / 10.0::DOUBLE / 3, 0), 1)), 6) AS tube_likeness FROM orders""")
def r14(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    o = o.select("o_orderkey", F.lit(0.0).alias("cone_kappa_h1_median"), (F.col("o_totalprice") / 1000).alias("cone_kappa_h4_median"), (F.col("o_totalprice") / 500).alias("tube_kappa_median"), (F.col("o_orderkey") % 40 / 10.0).alias("tube_d_eff_median"), (-F.col("o_totalprice")).alias("tube_log_det_median"), F.lit(3).alias("dims"))
    return r6(op.shape_indices(o).select("o_orderkey", "endpoint_ovality", "tube_elongation", "tube_compactness", "size", "tube_likeness"))


@query("t28_transport_ratio")
def t28(spark, d):
    c = op.cones(_models(spark, d), ["session"], "session int", 3)
    return r6(c.groupBy("session").pivot("h", [1, 2, 3, 4]).agg(F.median("q_ratio")).select("session", *[F.col(str(h)).alias(f"q_ratio_h{h}") for h in range(1, 5)]))
