"""Queries of the sequence operators."""

from pyspark.sql import functions as F

from tideline.functions.resample import uniform, uniform_sql
from tideline.operators import sequences as op
from tideline.operators.matrices import with_matrices
from tideline.operators.stats import ordered
from tideline.plans.registry import query
from tideline.plans.shapes import EVENTS, TRAJECTORY, events, r6, trajectory

AXES = ["m", "d", "e"]
TG = TRAJECTORY + ", tg AS (SELECT * FROM tr WHERE t_idx % 7 <> 3)"
SEG = TG + ", sg AS (SELECT *, t_idx - row_number() OVER (PARTITION BY session ORDER BY t_idx) AS segment FROM tg)"
W = "OVER (PARTITION BY session, segment ORDER BY t_idx)"
ST = SEG + f""", d1 AS (SELECT *, m - lag(m) {W} AS vm, d - lag(d) {W} AS vd, e - lag(e) {W} AS ve FROM sg), d2 AS (SELECT *, lag(vm) {W} AS um, lag(vd) {W} AS ud, lag(ve) {W} AS ue FROM d1),
st AS (SELECT *, sqrt(vm*vm + vd*vd + ve*ve) AS speed, acos(least(greatest((vm*um + vd*ud + ve*ue) / (sqrt(vm*vm + vd*vd + ve*ve) * sqrt(um*um + ud*ud + ue*ue) + 1e-12), -1), 1)) AS angle FROM d2)"""


def gapped(spark, d):
    """Trajectories with every seventh row missing."""
    return trajectory(spark, d, 3).where("t_idx % 7 <> 3")


@query("w1_segments", "WITH " + SEG + " SELECT session, t_idx, segment FROM sg")
def w1(spark, d):
    return op.segments(gapped(spark, d), ["session"]).select("session", "t_idx", "segment")


@query("w2_w3_steps", "WITH " + ST + " SELECT session, t_idx, round(speed, 6) AS speed, round(angle, 6) AS angle FROM st")
def w2(spark, d):
    return r6(op.steps(gapped(spark, d), ["session"], AXES).select("session", "t_idx", "speed", "angle"))


PATH = ST + """, pp AS (SELECT session, segment, sum(speed) AS path, sqrt((arg_max(m, t_idx) - arg_min(m, t_idx))**2 + (arg_max(d, t_idx) - arg_min(d, t_idx))**2 + (arg_max(e, t_idx) - arg_min(e, t_idx))**2) AS direct, sum(angle) AS a, count(angle) AS na, count(speed) AS ns FROM st GROUP BY ALL),
ps AS (SELECT session, sum(path) AS path, sum(direct) AS direct, count(*) AS n_segments, sum(path) / sum(ns) AS mean_speed, sum(a) / sum(na) AS mean_angle FROM pp GROUP BY session)"""
PATH_COLS = "round(path, 6) AS path_length, round(direct, 6) AS endpoint_dist, n_segments, round(mean_speed, 6) AS speed_mean, round(mean_angle, 6) AS curvature_mean, round(CASE WHEN path > 0 THEN least(greatest(direct / path, 0), 1) END, 6) AS traj_efficiency"


@query("w4_path", "WITH " + PATH + f" SELECT session, {PATH_COLS} FROM ps")
def w4(spark, d):
    return r6(op.path_summary(gapped(spark, d), ["session"], AXES))


CODES = TG.replace(" WHERE t_idx % 7 <> 3", "") + """, qs AS (SELECT session, quantile_cont(m, 0.6) AS qm, quantile_cont(d, 0.6) AS qd, quantile_cont(e, 0.6) AS qe FROM tg GROUP BY session), cd AS (SELECT tg.*, ((m >= qm - 1e-12)::INT + 2 * (d >= qd - 1e-12)::INT + 4 * (e >= qe - 1e-12)::INT) AS code FROM tg JOIN qs USING (session))"""


def _entropy(counts, cells, by="session"):
    return f"SELECT {by}, -sum(greatest(p, 1e-12) / z * ln(greatest(p, 1e-12) / z)) - max({cells} - k) * 1e-12 / max(z) * ln(1e-12 / max(z)) AS entropy FROM (SELECT {by}, n / t AS p, sum(greatest(n / t, 1e-12)) OVER (PARTITION BY {by}) + ({cells} - k) * 1e-12 AS z, k FROM (SELECT *, sum(n) OVER (PARTITION BY {by}) AS t, count(*) OVER (PARTITION BY {by}) AS k FROM ({counts}))) GROUP BY {by}"


OCC = _entropy("SELECT session, code, count(*)::DOUBLE AS n FROM cd GROUP BY ALL", 8)
TRN = _entropy('SELECT session, code, nxt, count(*)::DOUBLE AS n FROM (SELECT session, code, lead(code) OVER (PARTITION BY session ORDER BY t_idx) AS nxt FROM cd) WHERE nxt IS NOT NULL GROUP BY ALL', 64)


@query("w5_occupancy_entropy", "WITH " + CODES + f" SELECT session, round(entropy, 6) AS entropy FROM ({OCC})")
def w5(spark, d):
    return r6(op.occupancy_entropy(op.corner_codes(trajectory(spark, d, 3), ["session"], AXES), ["session"]))


@query("w6_dwell_entropy", "WITH " + CODES + f" SELECT session, round(entropy, 6) AS entropy FROM ({OCC})")
def w6(spark, d):
    return r6(op.dwell_entropy(op.corner_codes(trajectory(spark, d, 3), ["session"], AXES), ["session"]))


@query("w7_transition_entropy", "WITH " + CODES + f" SELECT session, round(entropy, 6) AS entropy FROM ({TRN})")
def w7(spark, d):
    return r6(op.transition_entropy(op.corner_codes(trajectory(spark, d, 3), ["session"], AXES), ["session"]))


def _tau(axis):
    return f"""SELECT b.session, CASE WHEN any_value(b.n) >= 5 AND any_value(b.varied) THEN coalesce(min(lag) FILTER (c / v < exp(-1)), least(150, any_value(b.n) - 1)) * 2.0::DOUBLE END AS tau FROM (SELECT session, sum(x * x) AS v, count(*) AS n, max(x) > min(x) AS varied FROM ac_{axis} GROUP BY session) b
 LEFT JOIN (SELECT p.session, q.i - p.i AS lag, sum(p.x * q.x) AS c FROM ac_{axis} p JOIN ac_{axis} q ON p.session = q.session AND q.i - p.i BETWEEN 1 AND 150 GROUP BY ALL) l ON b.session = l.session GROUP BY b.session"""


def _ac(axis):
    return f"ac_{axis} AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY t_idx) AS i, {axis} - avg({axis}) OVER (PARTITION BY session) AS x FROM tr)"


@query("w8_autocorrelation", "WITH " + TRAJECTORY + ", " + _ac("m") + " SELECT session, round(tau, 6) AS tau FROM (" + _tau("m") + ")")
def w8(spark, d):
    return r6(op.autocorrelation_time(trajectory(spark, d, 3), ["session"], "m", 2.0))


GAPS = ", ".join(f"avg({a}) - median({a}) AS {a}_delta_mean_median" for a in AXES)


@query("w9_mean_median_gap", "WITH " + TRAJECTORY + " SELECT session, " + ", ".join(f"round(avg({a}) - median({a}), 6) AS {a}_delta_mean_median" for a in AXES) + " FROM tr GROUP BY session")
def w9(spark, d):
    return r6(trajectory(spark, d, 3).groupBy("session").agg(*[(F.avg(a) - F.median(a)).alias(f"{a}_delta_mean_median") for a in AXES]))


_SPREAD = [(f"{name}_{n}", f.format(c)) for c, name in (("speed", "speed"), ("angle", "curvature")) for n, f in (("median", "median({0})"), ("iqr", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)"), ("mad", "mad({0})"))]
RAW = ", ".join(f"{sql} AS {name}" for name, sql in _SPREAD)
SPREAD = ", ".join(f"round({name}, 6) AS {name}" for name, _ in _SPREAD)


@query("w10_dynamics", "WITH " + PATH.replace(" WHERE t_idx % 7 <> 3", "") + CODES.removeprefix(TG.replace(" WHERE t_idx % 7 <> 3", "")) + ", " + ", ".join(_ac(a) for a in AXES) + f""", hd AS (SELECT session, count(*) AS n_timepoints, bool_and(m IS NOT NULL AND d IS NOT NULL AND e IS NOT NULL) AS finite_ok, {GAPS} FROM tr GROUP BY session HAVING count(*) >= 5), oe AS ({OCC}), te AS ({TRN}), tm AS ({_tau('m')}), sp AS (SELECT session, count(speed) AS n_speeds, {RAW} FROM st GROUP BY session), td AS ({_tau('d')}), tv AS ({_tau('e')})
 SELECT hd.session, n_timepoints, finite_ok, n_speeds < 1 AS not_testable, CASE WHEN n_speeds < 1 THEN 'lt_min_timepoints_or_no_speed' END AS not_testable_reason, {SPREAD}, {', '.join(f'round({a}_delta_mean_median, 6) AS {a}_delta_mean_median' for a in AXES)}, {PATH_COLS}, round(oe.entropy, 6) AS corner_entropy, round(oe.entropy, 6) AS corner_dwell_entropy, round(te.entropy, 6) AS corner_transition_entropy, round(tm.tau, 6) AS m_tau_sec, round(td.tau, 6) AS d_tau_sec, round(tv.tau, 6) AS e_tau_sec
 FROM hd JOIN ps USING (session) JOIN sp USING (session) JOIN oe USING (session) JOIN te USING (session) JOIN tm USING (session) JOIN td USING (session) JOIN tv USING (session)""")
def w10(spark, d):
    return r6(op.dynamics(trajectory(spark, d, 3), ["session"], AXES, 2.0))


@query("w11_stage_dynamics")
def w11(spark, d):
    t = trajectory(spark, d)
    s = op.stage_slices(t.withColumn("stage", F.floor(F.col("t_idx") / 10).cast("int") % 3), "session", "stage", {0: "n1", 1: "n2", 2: "rem"}, 10)
    rows = op.dynamics(s, ["slice"], AXES, 2.0, least=10, session=["session"], levels=op.corner_levels(t, ["session"], AXES))
    return r6(with_matrices(rows, s.select("slice", "t_idx", F.array(*[F.col(f"x{i}") for i in range(9)]).alias("j")), ["slice"], "slice string", 3))


@query("w12_time_step", "WITH " + EVENTS + " SELECT subject, round(coalesce(median(dd) FILTER (dd > 0), 1), 6) AS dt FROM (SELECT subject, time - lag(time) OVER (PARTITION BY subject ORDER BY t_idx) AS dd FROM ev) GROUP BY subject")
def w12(spark, d):
    return r6(op.time_step(events(spark, d), ["subject"], "time"))


@query("w13_stride", "WITH " + EVENTS + ", s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY subject) > 20 THEN ceil(count(*) OVER (PARTITION BY subject) / 20)::BIGINT ELSE 1 END AS st FROM ev) SELECT subject, event_id, (t_idx / st)::BIGINT AS t_idx FROM s WHERE t_idx % st = 0")
def w13(spark, d):
    return op.stride(events(spark, d), ["subject"], 20).select("subject", "event_id", "t_idx")


@query("w14_super_windows", "WITH " + TRAJECTORY + """, l AS (SELECT session, max(t_idx) AS last FROM tr GROUP BY session), w AS (SELECT session, last, unnest(range(0, greatest(last - 2, 0) + 1)) AS win FROM l) SELECT session, win AS "window", least(win + 1, last - 1) AS center, unnest(range(win, least(win + 2, last) + 1)) AS member FROM w""")
def w14(spark, d):
    return op.super_windows(trajectory(spark, d, 3), ["session"])


@query("w15_rolling_stability", "WITH " + TRAJECTORY + ", c AS (SELECT session, t_idx, m, count(m) OVER w AS n, stddev_pop(m) OVER w AS s FROM tr WINDOW w AS (PARTITION BY session ORDER BY t_idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) SELECT session, t_idx, round(CASE WHEN n >= 2 THEN 1 / (s + 1e-12) END, 4) AS stability FROM c")
def w15(spark, d):
    return op.rolling_stability(trajectory(spark, d, 3), ["session"], "m").select("session", "t_idx", F.round("stability", 4).alias("stability"))


@query("w16_return_time", "WITH " + EVENTS + ", q AS (SELECT subject, median(value) AS md FROM ev GROUP BY subject), r AS (SELECT ev.*, md, min(CASE WHEN value >= 0.9::DOUBLE * md THEN time END) OVER (PARTITION BY subject ORDER BY t_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM ev JOIN q USING (subject)) SELECT event_id, round(CASE WHEN value < 0.8::DOUBLE * md THEN nx - time END, 3) AS return_time FROM r")
def w16(spark, d):
    return op.return_time(events(spark, d), ["subject"], "value", time="time").select("event_id", F.round("return_time", 3).alias("return_time"))


@query("w17_hysteresis", "WITH " + TRAJECTORY + """, g AS (SELECT session, t_idx, m, row_number() OVER o AS i, coalesce(m - lag(m) OVER o, 0) AS g FROM tr WINDOW o AS (PARTITION BY session ORDER BY t_idx))
 SELECT a.session, a.t_idx, round(abs(median(b.m) FILTER (b.g < 0) - median(b.m) FILTER (b.g > 0)), 6) AS gap FROM g a JOIN g b ON a.session = b.session AND b.i BETWEEN a.i - 5 AND a.i + 5 GROUP BY a.session, a.t_idx""")
def w17(spark, d):
    return r6(op.hysteresis(trajectory(spark, d, 3), ["session"], "m"))


@query("w18_growth_ratio", "WITH " + TRAJECTORY + " SELECT session, t_idx, round(exp(m - lag(m) OVER (PARTITION BY session ORDER BY t_idx)), 6) AS growth FROM tr")
def w18(spark, d):
    return r6(op.growth_ratio(trajectory(spark, d, 3), ["session"], "m").select("session", "t_idx", "growth"))


@query("w19_split_half", "WITH " + EVENTS + """, h AS (SELECT subject, value, row_number() OVER (PARTITION BY subject ORDER BY t_idx) - 1 AS i, count(*) OVER (PARTITION BY subject) AS nn FROM ev), j AS (SELECT a.subject, a.i, a.value AS a, b.value AS b, a.nn FROM h a LEFT JOIN h b ON a.subject = b.subject AND b.i = a.i + a.nn // 2 WHERE a.i < a.nn // 2 OR a.nn < 2),
 k AS (SELECT *, a IS NOT NULL AND b IS NOT NULL AND nn >= 2 AS ok FROM j), r AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY subject, ok ORDER BY a, i) END AS ra, CASE WHEN ok THEN row_number() OVER (PARTITION BY subject, ok ORDER BY b, i) END AS rb FROM k)
 SELECT subject, CASE WHEN max(nn) >= 4 THEN count(ra) ELSE 0 END AS n, round(CASE WHEN max(nn) >= 4 THEN median(a) END, 6) AS a_median, round(CASE WHEN max(nn) >= 4 THEN median(b) END, 6) AS b_median, round(CASE WHEN max(nn) >= 4 AND count(ra) >= 3 THEN corr(ra, rb) END, 6) AS rho FROM r GROUP BY subject""")
def w19(spark, d):
    return r6(op.split_half(events(spark, d), ["subject"], "value"))


def _dot(c):
    o = "OVER (PARTITION BY session ORDER BY t_idx)"
    return f"coalesce((lead({c}) {o} - lag({c}) {o}) / 2, lead({c}) {o} - {c}, {c} - lag({c}) {o}, 0)"


@query("w20_central_difference", "WITH " + TRAJECTORY + f" SELECT session, t_idx, round({_dot('m')}, 6) AS m_dot, round({_dot('d')}, 6) AS d_dot, round({_dot('e')}, 6) AS e_dot FROM tr")
def w20(spark, d):
    return r6(op.central_difference(trajectory(spark, d, 3), ["session"], AXES).select("session", "t_idx", "m_dot", "d_dot", "e_dot"))


@query("w21_time_speed", "WITH " + TRAJECTORY + ", v AS (SELECT session, sqrt((m - lag(m) OVER o)**2 + (d - lag(d) OVER o)**2 + (e - lag(e) OVER o)**2) / nullif(vec_id::DOUBLE - lag(vec_id) OVER o, 0) AS v FROM tr WINDOW o AS (PARTITION BY session ORDER BY t_idx)) SELECT session, round(median(v), 6) AS median_speed FROM v GROUP BY session")
def w21(spark, d):
    return r6(op.time_speed(trajectory(spark, d, 3).withColumn("time", F.col("vec_id").cast("double")), ["session"], AXES, "time"))


@query("w22_curvature", "WITH " + TRAJECTORY + """, c AS (SELECT session, sqrt((lead(m, 2) OVER o - 2 * lead(m) OVER o + m)**2 + (lead(d, 2) OVER o - 2 * lead(d) OVER o + d)**2 + (lead(e, 2) OVER o - 2 * lead(e) OVER o + e)**2) / nullif((lead(m) OVER o - m)**2 + (lead(d) OVER o - d)**2 + (lead(e) OVER o - e)**2, 0) AS c FROM tr WINDOW o AS (PARTITION BY session ORDER BY t_idx)),
 l AS (SELECT session, quantile_cont(c, 0.99) AS p, count(*) AS n FROM c WHERE c IS NOT NULL GROUP BY session) SELECT session, round(avg(c), 6) AS mean_curvature, round(stddev_pop(c), 6) AS std_curvature, count(*) AS n FROM c JOIN l USING (session) WHERE c IS NOT NULL AND (l.n <= 10 OR c < p) GROUP BY session""")
def w22(spark, d):
    return r6(op.curvature(trajectory(spark, d, 3), ["session"], AXES))


@query("w23_subject_centring", "WITH " + EVENTS + " SELECT event_id, round(value - median(value) OVER (PARTITION BY subject), 6) AS value_sc FROM ev")
def w23(spark, d):
    return r6(op.centre(events(spark, d), ["subject"], ["value"]).select("event_id", "value_sc"))


MED = EVENTS + ", md AS (SELECT condition, median(value) AS me, stddev_pop(value) AS sd, avg(value) AS av, mad(value) AS ma FROM ev GROUP BY condition)"


@query("w24_robust_z", "WITH " + MED + " SELECT event_id, round(CASE WHEN value IS NULL THEN NULL WHEN ma > 1e-12 THEN (value - me) / ma WHEN sd > 1e-12 THEN (value - me) / sd ELSE 0 END, 6) AS z FROM ev JOIN md USING (condition)")
def w24(spark, d):
    return r6(op.robust_z(events(spark, d), ["condition"], "value", large=True).select("event_id", F.col("z_value").alias("z")))


@query("w25_logistic_normalise", "WITH " + MED + " SELECT event_id, round(CASE WHEN value IS NOT NULL THEN 1 / (1 + exp(-CASE WHEN ma > 1e-12 THEN (value - me) / (1.4826::DOUBLE * ma) WHEN sd > 1e-12 THEN (value - av) / sd ELSE 0 END)) END, 6) AS norm FROM ev JOIN md USING (condition)")
def w25(spark, d):
    return r6(op.logistic_normalise(events(spark, d), ["condition"], {"value": "norm"}, large=True).select("event_id", "norm"))


@query("w26_min_max", "WITH " + EVENTS + " SELECT event_id, round((value - min(value) OVER (PARTITION BY subject)) / (max(value) OVER (PARTITION BY subject) - min(value) OVER (PARTITION BY subject)), 6) AS scaled FROM ev")
def w26(spark, d):
    return r6(op.min_max(events(spark, d), ["subject"], "value").select("event_id", "scaled"))


@query("w27_stage_slices", "WITH " + TRAJECTORY + ", s AS (SELECT session, t_idx, CASE (t_idx // 10) % 3 WHEN 0 THEN 'n1' WHEN 1 THEN 'n2' END AS label FROM tr) SELECT session, t_idx, session || ':stage_' || label AS slice FROM (SELECT *, count(*) OVER (PARTITION BY session, label) AS n FROM s WHERE label IS NOT NULL) WHERE n >= 10")
def w27(spark, d):
    t = trajectory(spark, d, 3).withColumn("stage", F.floor(F.col("t_idx") / 10).cast("int") % 3)
    return op.stage_slices(t, "session", "stage", {0: "n1", 1: "n2"}, 10).select("session", "t_idx", "slice")


@query("w28_matched_subsample", "WITH " + EVENTS + f", c AS (SELECT subject, min(c) AS n FROM (SELECT subject, condition, count(*) AS c FROM ev GROUP BY ALL) GROUP BY subject), k AS (SELECT *, row_number() OVER (PARTITION BY subject, condition ORDER BY {uniform_sql(0, '0', 'event_id', 'match')}, event_id) AS place FROM ev) SELECT subject, condition, event_id FROM k JOIN c USING (subject) WHERE place <= n")
def w28(spark, d):
    return op.matched_subsample(events(spark, d), ["subject"], "condition", uniform(0, F.lit(0), "event_id", "match"), "event_id").select("subject", "condition", "event_id")


@query("w29_density_matched", "WITH " + EVENTS + ", m AS (SELECT subject, median(k) AS mk FROM ev GROUP BY subject) SELECT subject, count(*) AS n_kept, round(CASE WHEN count(*) >= 5 THEN median(value) END, 6) AS median FROM ev JOIN m USING (subject) WHERE k <= mk GROUP BY subject")
def w29(spark, d):
    return r6(op.density_matched(events(spark, d), ["subject"], "k", "value"))


@query("w30_p_rank", "WITH " + EVENTS + " SELECT event_id, row_number() OVER (PARTITION BY condition ORDER BY value ASC NULLS LAST, event_id)::INTEGER AS p_rank FROM ev")
def w30(spark, d):
    e = events(spark, d).withColumn("missing", F.col("value").isNull())  # nulls last
    return ordered(e, ["condition"], ["missing", "value", "event_id"]).select("event_id", (F.col("__before") + 1).cast("int").alias("p_rank"))
