"""Queries of the signal operators."""

from pyspark.sql import functions as F

from tideline.operators import signals as op
from tideline.plans.registry import query
from tideline.plans.shapes import SIGNAL, TRAJECTORY, r6, signal, table, trajectory

WIDTH, STEP = 8, 4
KEY = ["session", "network"]
LIST = list(op.NETWORKS) + ["Other"]


def regions(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 8).cast("int").alias("k"))
    net = F.array(*[F.lit(n) for n in LIST])[F.col("k")]
    return c.select("c_custkey", F.concat(F.lit("7Networks_"), F.when(F.col("c_custkey") % 3 == 0, "LH").otherwise("RH"), F.lit("_"), net, F.lit("_p"), F.col("k")).alias("name"))


CASE = "CASE n " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in op.NETWORKS.items()) + " ELSE n END"
REGIONS = "WITH r0 AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'LH' ELSE 'RH' END AS hemisphere, [" + ", ".join(f"'{n}'" for n in LIST) + "][c_custkey % 8 + 1] AS n, c_custkey % 8 AS k FROM customer), rg AS (SELECT c_custkey, hemisphere, " + CASE + " AS network, 'p' || k AS subregion FROM r0)"


@query("x1_region_names", REGIONS + " SELECT * FROM rg")
def x1(spark, d):
    return op.parse_region(regions(spark, d), "name").drop("name")


@query("x2_coverage", REGIONS + ", nt AS (SELECT unnest(['" + "', '".join([*op.NETWORKS.values(), "cerebellum"]) + "']) AS network) SELECT nt.network, count(c_custkey) AS total, count(*) FILTER (hemisphere = 'LH') AS lh, count(*) FILTER (hemisphere = 'RH') AS rh FROM nt LEFT JOIN rg USING (network) GROUP BY nt.network")
def x2(spark, d):
    nets = spark.createDataFrame([(n,) for n in [*op.NETWORKS.values(), "cerebellum"]], "network string")
    return op.coverage(op.parse_region(regions(spark, d), "name"), nets)


@query("x3_network_signal", "WITH " + SIGNAL + " SELECT session, network, t_idx, round(avg(value), 6) AS mean, round(median(value), 6) AS median, count(value) AS n_rois FROM sg GROUP BY ALL")
def x3(spark, d):
    return r6(op.network_signal(signal(spark, d)))


@query("x3_first_component")
def x3b(spark, d):
    return r6(op.first_component(signal(spark, d)))


WIN = SIGNAL + f""", ls AS (SELECT session, max(t_idx) AS last FROM sg GROUP BY session), wn AS (SELECT session, roi, network, t_idx, value, win, win * {STEP} + {WIDTH} / 2.0::DOUBLE AS win_time FROM (SELECT sg.*, unnest(range(greatest(ceil((t_idx - {WIDTH} + 1) / {STEP})::BIGINT, 0), least(t_idx // {STEP}, (last + 1 - {WIDTH}) // {STEP}) + 1)) AS win FROM sg JOIN ls USING (session) WHERE last + 1 >= {WIDTH}))"""


def win(spark, d):
    return op.windows(signal(spark, d), WIDTH, STEP)


@query("x4_window_assignment", "WITH " + WIN + " SELECT session, roi, t_idx, win, win_time FROM wn")
def x4(spark, d):
    return win(spark, d).select("session", "roi", "t_idx", "win", "win_time")


ENT = ", en AS (SELECT session, network, win, avg(ln(v + 1e-12)) AS entropy FROM (SELECT session, network, win, roi, var_pop(value) AS v FROM wn GROUP BY ALL) GROUP BY ALL)"
MOB = ", mo AS (SELECT session, network, win, var_pop(dv) AS mobility FROM (SELECT session, network, win, v - lag(v) OVER (PARTITION BY session, network, win ORDER BY t_idx) AS dv FROM (SELECT session, network, win, t_idx, avg(value) AS v FROM wn GROUP BY ALL)) GROUP BY ALL)"
DIF = ", di AS (SELECT session, network, win, avg(abs(value - m)) AS diffusivity FROM (SELECT *, avg(value) OVER (PARTITION BY session, network, win, t_idx) AS m FROM wn) GROUP BY ALL)"


@query("x5_log_variance", "WITH " + WIN + ENT + " SELECT session, network, win, round(entropy, 6) AS entropy FROM en")
def x5(spark, d):
    return r6(op.log_variance(win(spark, d), KEY))


@query("x6_mobility", "WITH " + WIN + MOB + " SELECT session, network, win, round(mobility, 6) AS mobility FROM mo")
def x6(spark, d):
    return r6(op.mobility(win(spark, d), KEY))


@query("x7_diffusivity", "WITH " + WIN + DIF + " SELECT session, network, win, round(diffusivity, 6) AS diffusivity FROM di")
def x7(spark, d):
    return r6(op.diffusivity(win(spark, d), KEY))


@query("x8_power_modularity", "WITH " + WIN + """, z AS (SELECT session, network, win, t_idx, value, (value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-12) AS z FROM wn WINDOW w AS (PARTITION BY session, network, win, roi)),
 a AS (SELECT session, network, win, t_idx, sum(z) AS zs, sum(z * z) AS zz, sum(value * value) AS p, count(*) AS n FROM z GROUP BY ALL) SELECT session, network, win, round(sum(p) / sum(n), 6) AS power, round(sum(zs * zs - zz) / (count(*) * max(n) * (max(n) - 1)), 6) AS modularity FROM a GROUP BY ALL""")
def x8(spark, d):
    return r6(op.power_modularity(win(spark, d), KEY))


def _norm_cte(name, src, c, by="session, network"):
    return f", {name}0 AS (SELECT session, network, median({c}) AS me, stddev_pop({c}) AS sd, avg({c}) AS av, mad({c}) AS ma FROM {src} GROUP BY ALL), {name} AS (SELECT session, network, win, 1 / (1 + exp(-CASE WHEN ma > 1e-12 THEN ({c} - me) / (1.4826::DOUBLE * ma) WHEN sd > 1e-12 THEN ({c} - av) / sd ELSE 0 END)) AS v FROM {src} JOIN {name}0 USING (session, network))"


XYZ = WIN + ENT + MOB + DIF + _norm_cte("nm", "mo", "mobility") + _norm_cte("nd", "di", "diffusivity") + _norm_cte("ne", "en", "entropy")


@query("x9_network_coordinates", "WITH " + XYZ + " SELECT session, network, win, round(nm.v, 6) AS m, round(nd.v, 6) AS d, round(ne.v, 6) AS e FROM nm JOIN nd USING (session, network, win) JOIN ne USING (session, network, win)")
def x9(spark, d):
    return r6(op.coordinates(win(spark, d), KEY))


@query("x10_projection", "WITH " + XYZ + ", ax AS (SELECT session, network, win, 0.7::DOUBLE * nm.v + 0.3::DOUBLE * ne.v AS a, 0.5::DOUBLE * nd.v - 0.5::DOUBLE * nm.v AS b FROM nm JOIN nd USING (session, network, win) JOIN ne USING (session, network, win))" + _norm_cte("pa", "ax", "a") + _norm_cte("pb", "ax", "b") + " SELECT session, network, win, round(pa.v, 6) AS m_a, round(pb.v, 6) AS d_n FROM pa JOIN pb USING (session, network, win)")
def x10(spark, d):
    w = win(spark, d)
    f = op.mobility(w, KEY).join(op.diffusivity(w, KEY), [*KEY, "win"]).join(op.log_variance(w, KEY), [*KEY, "win"])
    out = op.project(f, KEY, ["mobility", "diffusivity", "entropy"], {"m_a": {"mobility": 0.7, "entropy": 0.3}, "d_n": {"diffusivity": 0.5, "mobility": -0.5}})
    return r6(out.select(*KEY, "win", "m_a", "d_n"))


@query("x11_geometry", "WITH " + TRAJECTORY + """, bx AS (SELECT session, (max(m) - min(m)) * (max(d) - min(d)) * (max(e) - min(e)) AS volume, count(*) AS n FROM tr GROUP BY session), pr AS (SELECT a.session, sqrt((a.m - b.m)**2 + (a.d - b.d)**2 + (a.e - b.e)**2) AS dist FROM tr a JOIN tr b ON a.session = b.session AND a.t_idx < b.t_idx),
 fr AS (SELECT session, avg(dist) AS mean_dist, max(dist) AS max_dist, count(*) AS pairs FROM pr GROUP BY session), cl AS (SELECT session, count(*) AS close FROM pr JOIN fr USING (session) WHERE dist <= 0.1::DOUBLE * max_dist GROUP BY session)
 SELECT session, round(volume, 6) AS volume, n, round(mean_dist, 6) AS mean_dist, round(max_dist, 6) AS max_dist, round(coalesce(close, 0) / pairs, 6) AS recurrence, round(2 * coalesce(close, 0) / n, 6) AS mean_neighbours FROM bx JOIN fr USING (session) LEFT JOIN cl USING (session)""")
def x11(spark, d):
    return r6(op.geometry(trajectory(spark, d, 3), "session", "t_idx", ["m", "d", "e"]).drop("mean_curvature", "std_curvature"))
