"""Queries of the aggregation operators."""

from pyspark.sql import functions as F

from tideline.operators import aggregates as op
from tideline.operators import joins
from tideline.plans.filters import FLAGGED, flagged
from tideline.plans.registry import query
from tideline.plans.shapes import EVENTS, SIGNAL, TRAJECTORY, events, r6, signal, table, trajectory


def _stats_sql(cols, by, source, having=""):
    parts = [f"count({c}) AS {c}_n_finite, round(count({c}) / count(*), 6) AS {c}_finite_frac, round(avg({c}), 6) AS {c}_mean, round(median({c}), 6) AS {c}_median, round(stddev_pop({c}), 6) AS {c}_std" for c in cols]
    ok = " AND ".join(f"count({c}) = count(*)" for c in cols)
    return f"SELECT {by}, count(*) AS n_total, {', '.join(parts)}, {ok} AS finite_ok FROM {source} GROUP BY {by}{having}"


@query("a1_finite_stats", "WITH " + EVENTS + " " + _stats_sql(["value"], "subject, condition", "ev"))
def a1(spark, d):
    return r6(op.finite_stats(events(spark, d), ["subject", "condition"], ["value"]))


SPREAD = """round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(stddev_pop({c}), 6) AS std, round(mad({c}), 6) AS mad, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr, min({c}) AS min, max({c}) AS max"""


@query("a2_robust_stats", "WITH " + EVENTS + " SELECT condition, count(value) AS n, " + SPREAD.format(c="value") + " FROM ev GROUP BY condition")
def a2(spark, d):
    return r6(op.spread(events(spark, d), ["condition"], "value", large=True))


FEATURE = """SELECT session, feature, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(mad(value), 6) AS mad, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(min(value), 6) AS min, round(max(value), 6) AS max,
 round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95, round(count(value) / count(*), 6) AS finite_frac, count(value) = count(*) AS finite_ok, count(value) < 3 AS not_testable FROM {} GROUP BY session, feature"""
LONG = SIGNAL + ", lg AS (SELECT session, t_idx, t_idx % 3 AS stage, 'f' || roi AS feature, CASE WHEN (t_idx * 7 + roi) % 97 <> 0 THEN value END AS value FROM sg)"


def long_features(spark, d):
    s = signal(spark, d)
    return s.select("session", "t_idx", (F.col("t_idx") % 3).alias("stage"), F.concat(F.lit("f"), F.col("roi")).alias("feature"), F.when((F.col("t_idx") * 7 + F.col("roi")) % 97 != 0, F.col("value")).alias("value"))


@query("a3_feature_summary", "WITH " + LONG + " " + FEATURE.format("lg"))
def a3(spark, d):
    return r6(op.feature_summary(long_features(spark, d), ["session"]))


@query("a4_feature_summary_by_stage", "WITH " + LONG + """, ok AS (SELECT session, t_idx, stage FROM lg GROUP BY ALL HAVING count(value) = count(*)), st AS (SELECT session, stage FROM ok GROUP BY ALL HAVING count(*) >= 10)
 , kp AS (SELECT lg.session || ':stage_' || lg.stage AS session, feature, value FROM lg JOIN ok USING (session, t_idx, stage) JOIN st USING (session, stage)) """ + FEATURE.format("kp"))
def a4(spark, d):
    kept = op.complete_rows(long_features(spark, d), ["session"], "t_idx", "stage", 10)
    return r6(op.feature_summary(kept.withColumn("session", F.concat(F.col("session").cast("string"), F.lit(":stage_"), F.col("stage"))), ["session"]))


@query("a5_global_3d", "WITH " + TRAJECTORY + " " + _stats_sql(["m", "d", "e"], "session", "tr"))
def a5(spark, d):
    return r6(op.finite_stats(trajectory(spark, d, 3), ["session"], ["m", "d", "e"]))


@query("a5_global_3d_by_stage", "WITH " + TRAJECTORY + ", st AS (SELECT *, t_idx % 3 AS stage FROM tr) " + _stats_sql(["m", "d", "e"], "session, stage", "st"))
def a5s(spark, d):
    return r6(op.finite_stats(trajectory(spark, d, 3).withColumn("stage", F.col("t_idx") % 3), ["session", "stage"], ["m", "d", "e"]))


NINE = [f"x{i}" for i in range(9)]


@query("a6_global_9d", "WITH " + TRAJECTORY + " " + _stats_sql(NINE, "session", "tr"))
def a6(spark, d):
    return r6(op.finite_stats(trajectory(spark, d), ["session"], NINE))


WIDE = SIGNAL + ", wd AS (SELECT session, network, t_idx, t_idx % 3 AS stage, avg(value) AS m, var_pop(value) AS d, max(value) - min(value) AS e, count(*) AS n_regions FROM sg GROUP BY ALL)"


def wide_network(spark, d):
    s = signal(spark, d).groupBy("session", "network", "t_idx")
    return s.agg(F.avg("value").alias("m"), F.var_pop("value").alias("d"), (F.max("value") - F.min("value")).alias("e"), F.count(F.lit(1)).alias("n_regions")).withColumn("stage", F.col("t_idx") % 3)


@query("a7_regional_3d", "WITH " + WIDE + " " + _stats_sql(["m", "d", "e"], "session, network", "wd"))
def a7(spark, d):
    return r6(op.finite_stats(wide_network(spark, d), ["session", "network"], ["m", "d", "e"]))


@query("a8_regional_by_stage", "WITH " + WIDE + " " + _stats_sql(["m", "d", "e"], "session, network, stage", "wd"))
def a8(spark, d):
    return r6(op.finite_stats(wide_network(spark, d), ["session", "network", "stage"], ["m", "d", "e"]))


@query("a9_stage_summary", "WITH " + EVENTS + " SELECT condition, count(DISTINCT subject) AS n_subjects, count(DISTINCT (subject, k % 4)) AS n_blocks, count(*) AS n_windows, round(avg(value), 6) AS value_mean, round(median(value), 6) AS value_median FROM ev GROUP BY condition")
def a9(spark, d):
    return r6(op.stage_summary(events(spark, d).withColumn("block", F.col("k") % 4), "condition", "subject", "block", ["value"]))


@query("a10_medians", "WITH " + EVENTS + " SELECT subject, condition, round(median(value), 6) AS value, round(median(k), 6) AS k FROM ev GROUP BY subject, condition")
def a10(spark, d):
    return r6(op.medians(events(spark, d), ["subject", "condition"], ["value", "k"]))


TYPES = ["click", "error", "purchase", "view"]


@query("a11_pivot", "WITH " + EVENTS + " SELECT subject, " + ", ".join(f"round(median(value) FILTER (condition = '{t}'), 6) AS {t}" for t in TYPES) + " FROM ev GROUP BY subject HAVING " + " AND ".join(f"count(value) FILTER (condition = '{t}') > 0" for t in TYPES))
def a11(spark, d):
    return r6(op.pivot(events(spark, d), ["subject"], "condition", TYPES, F.median("value"), need_all=True))


@query("a11_count_grid", "WITH " + EVENTS + " SELECT subject, " + ", ".join(f"count(*) FILTER (condition = '{t}') AS {t}" for t in TYPES) + f" FROM ev GROUP BY subject")
def a11b(spark, d):
    return op.pivot(events(spark, d), ["subject"], "condition", TYPES, F.count(F.lit(1)), fill=0)


@query("a12_wide_features", "WITH " + EVENTS + """, md AS (SELECT subject, min_by(condition, event_id) FILTER (k % 4 <> 0) AS note FROM ev GROUP BY subject), pv AS (SELECT subject, avg(value) FILTER (condition = 'view') AS "view", avg(value) FILTER (condition = 'click') AS click FROM ev GROUP BY subject)
 SELECT subject, note, round("view", 6) AS "view", round(click, 6) AS click FROM md LEFT JOIN pv USING (subject)""")
def a12(spark, d):
    e = events(spark, d).withColumn("note", F.when(F.col("k") % 4 != 0, F.col("condition")).otherwise(" "))
    return r6(op.first_known(e, ["subject"], ["note"], "event_id").join(op.pivot(e, ["subject"], "condition", ["view", "click"], F.avg("value")), "subject", "left"))


@query("a13_keep_best", "WITH " + EVENTS + """ SELECT subject, event_id, k, value FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY CASE WHEN k % 3 <> 0 THEN k % 10 END ASC NULLS LAST, CASE WHEN k % 4 <> 0 THEN k % 7 END ASC NULLS LAST, abs(value) DESC NULLS LAST, event_id) AS n FROM ev) WHERE n = 1""")
def a13(spark, d):
    e = events(spark, d).withColumn("q", F.expr("case when k % 3 <> 0 then k % 10 end")).withColumn("p", F.expr("case when k % 4 <> 0 then k % 7 end"))
    return op.keep_best(e, ["subject"], "value", "event_id").select("subject", "event_id", "k", "value")


INV = "count(DISTINCT subject) AS sessions, count(*) AS windows, sum(coalesce(finite_ok, false)::INT)::BIGINT AS anchored, sum((value IS NOT NULL)::INT)::BIGINT AS finite, round(sum(coalesce(finite_ok, false)::INT) / count(*), 6) AS anchored_frac, round(count(value) / count(*), 6) AS finite_frac FROM fl"


@query("a14_inventory", FLAGGED + f"SELECT condition, {INV} GROUP BY condition UNION ALL SELECT '*', {INV}")
def a14(spark, d):
    return r6(op.inventory(flagged(spark, d).withColumn("finite", F.col("value").isNotNull()), "subject", "finite_ok", "finite", "condition"))


@query("a15_capabilities", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k, json_extract(props, '$.k') IS NOT NULL AS has_k, 0::BIGINT AS windows, false AS has_windows FROM events")
def a15(spark, d):
    e = table(spark, d, "events").select("event_id", "props")
    return op.capabilities(e, "props", {"k": "$.k", "windows": "$.stats.windows"}).drop("props")


@query("a16_block_qc", FLAGGED + "SELECT condition, count(*) AS n_rows, count(DISTINCT subject) AS n_subjects, round(avg(coalesce(finite_ok, true)::INT), 6) AS finite_ok_rate, round(avg(coalesce(not_testable, false)::INT), 6) AS not_testable_rate, round(avg(coalesce(validity_limited, false)::INT), 6) AS validity_limited_rate FROM fl GROUP BY condition")
def a16(spark, d):
    return r6(op.qc_summary(flagged(spark, d), ["condition"], "subject"))


@query("a17_run_qc", FLAGGED + """SELECT 'block' AS kind, condition AS analysis_type, NULL::VARCHAR AS metric_role, NULL::VARCHAR AS contrast_name, count(*) AS n_rows, NULL::DOUBLE AS value_rate, NULL::BIGINT AS n_tests, NULL::DOUBLE AS median_pairs, NULL::BIGINT AS n_significant FROM fl GROUP BY condition
 UNION ALL SELECT 'metrics', condition, CASE WHEN k % 2 = 0 THEN 'main' ELSE 'aux' END, NULL, count(*), round(avg((value IS NOT NULL)::INT), 6), NULL, NULL, NULL FROM fl GROUP BY 2, 3
 UNION ALL SELECT 'tests', condition, NULL, 'c' || k % 3, NULL, NULL, count(*), round(median(k), 6), sum((value <= 5)::INT)::BIGINT FROM fl GROUP BY 2, 4""")
def a17(spark, d):
    f = flagged(spark, d).withColumnRenamed("condition", "analysis_type")
    blocks = f.groupBy("analysis_type").agg(F.count(F.lit(1)).alias("n_rows"))
    metrics = f.withColumn("metric_role", F.expr("case when k % 2 = 0 then 'main' else 'aux' end"))
    tests = f.select(F.expr("concat('c', k % 3)").alias("contrast_name"), "analysis_type", F.col("k").alias("n_pairs"), (F.col("value") / 100).alias("q_value"))
    return r6(op.run_qc(blocks, metrics, tests))


@query("a18_coverage", FLAGGED + "SELECT condition, count(*) AS n, round(avg(finite_ok::INT), 6) AS finite_ok_rate, round(avg((value IS NOT NULL)::INT), 6) AS value_filled, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std FROM fl GROUP BY condition")
def a18(spark, d):
    return r6(op.coverage(flagged(spark, d), ["condition"], ["finite_ok"], ["value"]))


@query("a19_metric_triple", "WITH " + EVENTS + """ SELECT * FROM (SELECT subject, CASE k % 2 WHEN 0 THEN 'even' ELSE '1' END AS condition, round(median(value) FILTER (condition = 'view'), 6) AS "view", round(median(value) FILTER (condition = 'click'), 6) AS click, round(median(value) FILTER (condition = 'error'), 6) AS error FROM ev GROUP BY subject, k % 2) WHERE "view" IS NOT NULL AND click IS NOT NULL AND error IS NOT NULL""")
def a19(spark, d):
    e = events(spark, d).select("subject", F.col("condition").alias("metric"), (F.col("k") % 2).cast("string").alias("condition"), "value")
    return r6(op.metric_triple(e, ["subject", "condition"], ["view", "click", "error"], {"0": "even"}))


OCC = TRAJECTORY + """, rg AS (SELECT session, min(m) lm, max(m) hm, min(d) ld, max(d) hd, min(e) le, max(e) he FROM tr GROUP BY session),
oc AS (SELECT session, least(floor((m - lm) / (hm - lm + 1e-9) * 6), 5)::INTEGER AS i0, least(floor((d - ld) / (hd - ld + 1e-9) * 6), 5)::INTEGER AS i1, least(floor((e - le) / (he - le + 1e-9) * 6), 5)::INTEGER AS i2, count(*) AS n FROM tr JOIN rg USING (session) GROUP BY ALL)"""


@query("a20_occupancy", "WITH " + OCC + " SELECT * FROM oc")
def a20(spark, d):
    return op.occupancy(trajectory(spark, d, 3), ["session"], ["m", "d", "e"], 6)


KERNEL = [0.25, 0.5, 0.25]
SM = OCC + """, kn AS (SELECT * FROM (VALUES (-1, 0.25::DOUBLE), (0, 0.5::DOUBLE), (1, 0.25::DOUBLE)) k(off, w)), ax AS (SELECT range::INTEGER AS p FROM range(6)),
s0 AS (SELECT session, p AS i0, i1, i2, sum(n * w) AS v FROM oc, kn, ax WHERE least(greatest(p + off, 0), 5) = i0 GROUP BY ALL), s1 AS (SELECT session, i0, p AS i1, i2, sum(v * w) AS v FROM s0, kn, ax WHERE least(greatest(p + off, 0), 5) = i1 GROUP BY ALL),
s2 AS (SELECT session, i0, i1, p AS i2, sum(v * w) AS density FROM s1, kn, ax WHERE least(greatest(p + off, 0), 5) = i2 GROUP BY ALL)"""


@query("a21_smooth", "WITH " + SM + " SELECT session, i0, i1, i2, round(density, 6) AS density FROM s2")
def a21(spark, d):
    return r6(op.smooth(op.occupancy(trajectory(spark, d, 3), ["session"], ["m", "d", "e"], 6), ["session"], 6, KERNEL))


@query("a21_iso_shell", "WITH " + SM + """, ins AS (SELECT s2.* FROM s2 JOIN (SELECT session, quantile_cont(density, 0.7) AS level FROM s2 GROUP BY session) USING (session) WHERE density >= level - 1e-12)
 SELECT a.session, a.i0, a.i1, a.i2, round(any_value(a.density), 6) AS density FROM ins a LEFT JOIN ins b ON a.session = b.session AND abs(a.i0 - b.i0) + abs(a.i1 - b.i1) + abs(a.i2 - b.i2) = 1 GROUP BY 1, 2, 3, 4 HAVING count(b.session) < 6""")
def a21b(spark, d):
    return r6(op.shell(op.smooth(op.occupancy(trajectory(spark, d, 3), ["session"], ["m", "d", "e"], 6), ["session"], 6, KERNEL), ["session"], 0.7))


@query("a22_auto_bins", "WITH " + EVENTS + """, r AS (SELECT min(value) - (max(value) - min(value)) * 0.08::DOUBLE AS lo, max(value) + (max(value) - min(value)) * 0.08::DOUBLE AS hi FROM ev), b AS (SELECT condition, CASE WHEN count(value) <= 1 THEN 5 ELSE least(greatest(ceil(sqrt(count(value))), 6), 24) END::INTEGER AS bins FROM ev WHERE value IS NOT NULL GROUP BY condition)
 SELECT condition, bins, least(floor((value - lo) / (hi - lo) * bins), bins - 1)::INTEGER AS bin, count(*) AS n FROM ev JOIN b USING (condition), r WHERE value IS NOT NULL GROUP BY ALL""")
def a22(spark, d):
    return op.auto_bins(events(spark, d), ["condition"], "value")


@query("a23_table_normalisation", """SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), o_orderpriority) AS task, CASE WHEN o_orderkey % 6 = 0 THEN 'price_nonfinite' ELSE '' END AS reason, o_orderkey % 6 <> 0 AS ok FROM orders""")
def a23(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'F')").alias("task_name"), F.col("o_orderpriority").alias("run"), F.expr("case when o_orderkey % 6 <> 0 then o_totalprice else double('NaN') end").alias("price"))
    return op.normalise_table(o, {"task": ["absent", "task_name", "run"]}, ["price", "o_orderkey"]).select("o_orderkey", "task", "reason", "ok")


@query("a24_flatten_stats", "WITH " + EVENTS + """, g AS (SELECT subject, condition, count(value) AS n, 1 - count(value) / count(*) AS nan_frac, avg(value) AS mean, max(value) AS high FROM ev GROUP BY ALL)
 SELECT subject, max(round(mean, 6)) FILTER (condition = 'view' AND n >= 8 AND nan_frac <= 0.2) AS c_view_value_mean, max(high) FILTER (condition = 'click' AND n >= 8 AND nan_frac <= 0.2) AS c_click_value_high FROM g GROUP BY subject""")
def a24(spark, d):
    g = events(spark, d).groupBy("subject", F.col("condition").alias("family")).agg(F.count("value").alias("n"), (1 - F.count("value") / F.count(F.lit(1))).alias("nan_frac"), F.avg("value").alias("mean"), F.max("value").alias("high"))
    long = g.unpivot(["subject", "family", "n", "nan_frac"], ["mean", "high"], "stat", "value").withColumn("metric", F.lit("value"))
    return r6(op.flatten_stats(long, ["subject"], ["c_view_value_mean", "c_click_value_high"], 8, 0.2, "c"))


@query("a25_event_rate", "WITH " + EVENTS + """, c AS (SELECT v.subject, v.event_id, any_value(v.time) AS time, count(p.event_id) AS n FROM ev v LEFT JOIN ev p ON p.condition = 'purchase' AND p.subject = v.subject AND p.time >= v.time AND p.time < v.time + 36000 WHERE v.condition = 'view' GROUP BY ALL)
 SELECT subject, round(max(time) + 36000 - min(time), 3) AS duration, sum(n)::BIGINT AS n_events, round(median(n), 6) AS median_count, round(avg(n), 6) AS mean_count, round(sum(n) / (max(time) + 36000 - min(time)), 9) AS rate_hz FROM c GROUP BY subject""")
def a25(spark, d):
    e = events(spark, d)
    v, p = (e.where(F.col("condition") == c).select("subject", "event_id", "time") for c in ("view", "purchase"))
    n = joins.interval_count(v, p, "subject", "time", 36000.0, "time", "event_id").withColumn("end", F.col("time") + 36000)
    out = op.event_rate(n, ["subject"], "time", "end", "n_inside")
    return out.select("subject", F.round("duration", 3).alias("duration"), "n_events", F.round("median_count", 6).alias("median_count"), F.round("mean_count", 6).alias("mean_count"), F.round("rate_hz", 9).alias("rate_hz"))


@query("a26_interval_features", "WITH " + EVENTS + """, f AS (SELECT subject, count(value) AS n, avg(value) AS level, CASE WHEN count(value) >= 4 THEN regr_slope(value, t_idx::DOUBLE) END AS slope, avg(abs(k - 50.0::DOUBLE)) AS phasic, sum((k > 90)::INT)::BIGINT AS peaks, avg(k - 50.0::DOUBLE) FILTER (k > 90) AS height FROM ev GROUP BY subject)
 SELECT subject, n, round(level, 6) AS level, round(slope, 6) AS slope, round(phasic, 6) AS phasic, peaks, round(height, 6) AS height, false AS failed, round(peaks / (n / 2.0::DOUBLE), 6) AS peak_rate, round(peaks / (n / 2.0::DOUBLE) + abs(slope), 6) AS arousal FROM f WHERE n >= 20""")
def a26(spark, d):
    s = events(spark, d).select("subject", F.col("t_idx").cast("double").alias("time"), F.col("value").alias("tonic"), (F.col("k") - 50.0).alias("phasic"), (F.col("k") > 90).cast("long").alias("peak"))
    return r6(op.interval_features(s, ["subject"], 10, 2).where("not failed"))


@query("a27_validity_table", "WITH " + EVENTS + """, h AS (SELECT condition, value AS a, k::DOUBLE AS b FROM ev WHERE value IS NOT NULL), rk AS (SELECT condition, (rank() OVER (PARTITION BY condition ORDER BY a) + (count(*) OVER (PARTITION BY condition, a) - 1) / 2.0)::DOUBLE AS ra, (rank() OVER (PARTITION BY condition ORDER BY b) + (count(*) OVER (PARTITION BY condition, b) - 1) / 2.0)::DOUBLE AS rb FROM h)
 SELECT condition, round(median_a, 6) AS median_a, round(median_b, 6) AS median_b, round(r, 6) AS r, n FROM (SELECT condition, median(a) AS median_a, median(b) AS median_b, count(*) AS n FROM h GROUP BY condition) JOIN (SELECT condition, corr(ra, rb) AS r FROM rk GROUP BY condition) USING (condition)""")
def a27(spark, d):
    from tideline.operators.stats import spearman

    e = events(spark, d).select("condition", F.col("value").alias("a"), F.col("k").cast("double").alias("b")).where("a is not null")
    m = e.groupBy("condition").agg(F.median("a").alias("median_a"), F.median("b").alias("median_b"))
    return r6(m.join(spearman(e, ["condition"], "a", "b", 3), "condition").select("condition", "median_a", "median_b", "r", "n"))
