"""Queries of the contrast and statistics operators."""

from pyspark.sql import functions as F

from tideline.functions.resample import draw_sql, flip_sql
from tideline.functions.scalars import mean_in_order
from tideline.operators import contrasts as op
from tideline.operators import joins, stats
from tideline.plans.registry import query
from tideline.plans.shapes import EVENTS, events, r6, table

PAIRS = [("view_purchase", "view", "purchase"), ("click_error", "click", "error"), ("click_view", "click", "view")]


def long_metrics(spark, d):
    """Two metrics of the events in long form, with a quality flag."""
    e = events(spark, d).withColumn("k", F.col("k").cast("double")).select("subject", "condition", "event_id", "value", "k")
    return e.unpivot(["subject", "condition", "event_id"], ["value", "k"], "metric", "value").withColumn("ok", F.col("value").isNotNull() & (F.col("event_id") % 5 != 0))


LONG = EVENTS + ", lm AS (SELECT subject, condition, event_id, metric, v AS value, v IS NOT NULL AND event_id % 5 <> 0 AS ok FROM (SELECT subject, condition, event_id, 'value' AS metric, value AS v FROM ev UNION ALL SELECT subject, condition, event_id, 'k', k::DOUBLE FROM ev))"
CT = "ct AS (SELECT * FROM (VALUES ('view_purchase', 'view', 'purchase'), ('click_error', 'click', 'error'), ('click_view', 'click', 'view')) t(contrast_name, l, r))"
COLLAPSED = LONG + ", " + CT + """, cl AS (SELECT contrast_name, metric, subject, count(*) FILTER (condition = l) AS lt, count(*) FILTER (condition = r) AS rt, count(*) FILTER (condition = l AND ok) AS lq, count(*) FILTER (condition = r AND ok) AS rq,
 avg(value) FILTER (condition = l AND ok) AS lv, avg(value) FILTER (condition = r AND ok) AS rv FROM lm JOIN ct ON condition = l OR condition = r GROUP BY ALL), df AS (SELECT contrast_name, metric, subject, rv - lv AS diff FROM cl WHERE rv - lv IS NOT NULL)"""


def _contrasts(spark):
    return spark.createDataFrame(PAIRS, "contrast_name string, left string, right string")


def _collapsed(spark, d):
    return op.collapse(long_metrics(spark, d), _contrasts(spark), ["metric"], ["subject"], "event_id")


def _diffs(spark, d):
    return _collapsed(spark, d).withColumn("diff", F.col("right") - F.col("left")).where("diff is not null").select("contrast_name", "metric", "subject", "diff")


@query("t1_paired_contrast", "WITH " + COLLAPSED + """ SELECT contrast_name, metric, sum(lt)::BIGINT AS left_n_total, sum(rt)::BIGINT AS right_n_total, sum(lq)::BIGINT AS left_n_qc, sum(rq)::BIGINT AS right_n_qc, count(rv - lv) AS n_pairs,
 round(avg(lv) FILTER (rv IS NOT NULL), 6) AS left_mean, round(avg(rv) FILTER (lv IS NOT NULL), 6) AS right_mean, round(median(lv) FILTER (rv IS NOT NULL), 6) AS left_median, round(median(rv) FILTER (lv IS NOT NULL), 6) AS right_median, round(avg(rv - lv), 6) AS effect_estimate,
 round(sum(lq) / sum(lt), 6) AS left_qc_rate, round(sum(rq) / sum(rt), 6) AS right_qc_rate, round(avg(rv - lv) / stddev_samp(rv - lv), 6) AS effect_size, CASE WHEN count(rv - lv) = 0 THEN 'no pairs' WHEN count(rv - lv) < 3 THEN 'too few pairs' END AS skip_reason FROM cl GROUP BY contrast_name, metric""")
def t1(spark, d):
    return r6(op.paired_contrast(_collapsed(spark, d), ["metric"]))


UNPAIRED = """count(v) FILTER (lf) AS left_n, round(avg(v) FILTER (lf), 6) AS left_mean, round(median(v) FILTER (lf), 6) AS left_median, count(v) FILTER (NOT lf) AS right_n, round(avg(v) FILTER (NOT lf), 6) AS right_mean, round(median(v) FILTER (NOT lf), 6) AS right_median, round(avg(v) FILTER (NOT lf) - avg(v) FILTER (lf), 6) AS effect_estimate,
 round((avg(v) FILTER (NOT lf) - avg(v) FILTER (lf)) / sqrt(((count(v) FILTER (lf) - 1) * var_samp(v) FILTER (lf) + (count(v) FILTER (NOT lf) - 1) * var_samp(v) FILTER (NOT lf)) / (count(v) - 2)), 6) AS effect_size"""


@query("t2_unpaired_contrast", "SELECT o_orderpriority, " + UNPAIRED + ", NULL::VARCHAR AS skip_reason FROM (SELECT o_orderpriority, o_totalprice AS v, o_orderstatus = 'F' AS lf FROM orders) GROUP BY o_orderpriority")
def t2(spark, d):
    return r6(op.unpaired_contrast(table(spark, d, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F", "o_totalprice"))


@query("t3_effect_sizes", "WITH " + COLLAPSED + " SELECT contrast_name, metric, count(diff) AS n, round(avg(diff) / stddev_samp(diff), 6) AS dz, round(avg(diff) / (stddev_pop(diff) + 1e-12), 6) AS dz_pop FROM df GROUP BY ALL")
def t3(spark, d):
    return r6(_diffs(spark, d).groupBy("contrast_name", "metric").agg(F.count("diff").alias("n"), (F.avg("diff") / F.stddev_samp("diff")).alias("dz"), (F.avg("diff") / (F.stddev_pop("diff") + 1e-12)).alias("dz_pop")))


@query("t4_exact_permutation", "WITH " + COLLAPSED + """, f AS (SELECT contrast_name, metric, diff, subject // 10 AS block, row_number() OVER (PARTITION BY contrast_name, metric, subject // 10 ORDER BY subject) - 1 AS i, count(*) OVER (PARTITION BY contrast_name, metric, subject // 10) AS n FROM df),
 s AS (SELECT contrast_name, metric, block, rep, any_value(n) AS n, sum(CASE WHEN (rep >> i) % 2 = 1 THEN -diff ELSE diff END) AS s, sum(diff) AS o FROM f, range(1024) r(rep) WHERE rep < (1::BIGINT << n) GROUP BY ALL)
 SELECT contrast_name, metric, block, max(n) AS n, round((sum((abs(s) >= abs(o) - 1e-9)::INT) + 1) / (count(*) + 1), 6) AS p FROM s GROUP BY contrast_name, metric, block""")
def t4(spark, d):
    blocks = _diffs(spark, d).withColumn("block", F.expr("subject div 10"))  # of ten subjects at most, each with its own test
    return r6(stats.exact_paired_p(blocks, ["contrast_name", "metric", "block"], "diff", "subject"))


#: As many as the studies take: permutations and bootstrap samples.
PERMUTATIONS, BOOTSTRAPS = 5000, 2000
REP, BOOT_REP = f"range({PERMUTATIONS}) r(rep)", f"range({BOOTSTRAPS}) r(rep)"


@query("t4_random_permutation", "WITH " + COLLAPSED + f""", s AS (SELECT contrast_name, metric, rep, avg({flip_sql(0, 'rep', 'subject')} * diff) AS s, avg(diff) AS o FROM df, {REP} GROUP BY ALL) SELECT contrast_name, metric, round((sum((abs(s) >= abs(o) - 1e-9)::INT) + 1) / ({PERMUTATIONS} + 1), 6) AS p FROM s GROUP BY ALL""")
def t4b(spark, d):
    return r6(stats.paired_permutation_p(_diffs(spark, d), ["contrast_name", "metric"], "diff", "subject", PERMUTATIONS))


@query("t5_label_permutation", f"""WITH c AS (SELECT c_custkey, c_acctbal AS v, c_mktsegment = 'BUILDING' AS lf, count(*) FILTER (c_mktsegment = 'BUILDING') OVER () AS nl FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY {draw_sql(0, 'rep', 'c_custkey', 'label')}, c_custkey) AS k FROM c, {REP}),
 s AS (SELECT rep, avg(v) FILTER (k > nl) - avg(v) FILTER (k <= nl) AS s, avg(v) FILTER (NOT lf) - avg(v) FILTER (lf) AS o FROM k GROUP BY rep) SELECT 'all' AS grp, round((sum((abs(s) >= abs(o) - 1e-9)::INT) + 1) / {PERMUTATIONS + 1}, 6) AS p FROM s""")
def t5(spark, d):
    c = table(spark, d, "customer").select(F.lit("all").alias("grp"), "c_custkey", "c_acctbal", (F.col("c_mktsegment") == "BUILDING").alias("lf"))
    return r6(stats.label_permutation_p(c, ["grp"], "c_acctbal", "lf", "c_custkey", PERMUTATIONS))


BOOT = f""", ix AS (SELECT contrast_name, metric, subject, diff, row_number() OVER (PARTITION BY contrast_name, metric ORDER BY subject) - 1 AS i, count(*) OVER (PARTITION BY contrast_name, metric) AS n FROM df),
 dr AS (SELECT contrast_name, metric, rep, ((({draw_sql(0, 'rep', 'subject', 'boot')})::UHUGEINT * n::UHUGEINT) >> 32)::BIGINT AS i FROM ix, {BOOT_REP})"""


@query("t6_bootstrap_ci", "WITH " + COLLAPSED + BOOT + """, s AS (SELECT contrast_name, metric, rep, avg(diff) AS s FROM dr JOIN ix USING (contrast_name, metric, i) GROUP BY ALL)
 SELECT contrast_name, metric, round(quantile_cont(s, 0.025), 6) AS ci_low, round(quantile_cont(s, 0.975), 6) AS ci_high, round(stddev_samp(s), 6) AS se, quantile_cont(s, 0.025) > 0 OR quantile_cont(s, 0.975) < 0 AS excludes_zero FROM s GROUP BY ALL""")
def t6(spark, d):
    return r6(stats.bootstrap_ci(_diffs(spark, d), ["contrast_name", "metric"], "diff", "subject", BOOTSTRAPS))


BH = "SELECT grp, event_id, round(CASE WHEN p IS NOT NULL THEN least(1, min(q0) OVER (PARTITION BY grp, p IS NULL ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END, 6) AS q FROM (SELECT *, p * count(p) OVER (PARTITION BY grp, p IS NULL) / row_number() OVER (PARTITION BY grp, p IS NULL ORDER BY p, event_id) AS q0, row_number() OVER (PARTITION BY grp, p IS NULL ORDER BY p, event_id) AS n FROM pv)"


@query("t7_bh_fdr", "WITH " + EVENTS + ", pv AS (SELECT condition AS grp, event_id, CASE WHEN value IS NOT NULL THEN k / 100.0::DOUBLE END AS p FROM ev) " + BH)
def t7(spark, d):
    e = events(spark, d).select(F.col("condition").alias("grp"), "event_id", F.when(F.col("value").isNotNull(), F.col("k") / 100.0).alias("p"))
    return r6(stats.fdr_of_rows(e, ["grp"], "p", "event_id").select("grp", "event_id", "q"))


@query("t7_bh_null_as_one", "WITH " + EVENTS + ", pv AS (SELECT condition AS grp, event_id, CASE WHEN value IS NOT NULL THEN k / 100.0::DOUBLE ELSE 1 END AS p FROM ev) " + BH)
def t7b(spark, d):
    e = events(spark, d).select(F.col("condition").alias("grp"), "event_id", F.when(F.col("value").isNotNull(), F.col("k") / 100.0).alias("p"))
    return r6(stats.fdr_of_rows(e, ["grp"], "p", "event_id", True).select("grp", "event_id", "q"))


def _rank(c, by):
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0::DOUBLE)"


@query("t8_spearman", "WITH " + EVENTS + f", rk AS (SELECT subject, {_rank('value', 'subject')} AS a, {_rank('k', 'subject')} AS b FROM ev WHERE value IS NOT NULL) SELECT subject, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN corr(a, b) END, 6) AS r FROM rk GROUP BY subject")
def t8(spark, d):
    return r6(stats.spearman(events(spark, d), ["subject"], "value", "k"))


@query("t8_spearman_p")
def t8p(spark, d):
    return r6(stats.spearman(events(spark, d), ["subject"], "value", "k", p=True))


@query("t9_partial_spearman", "WITH " + EVENTS + f""", rk AS (SELECT subject, {_rank('value', 'subject')} AS a, {_rank('k', 'subject')} AS b, {_rank('t_idx', 'subject')} AS c FROM ev WHERE value IS NOT NULL), co AS (SELECT subject, count(*) AS n, corr(a, b) AS xy, corr(a, c) AS xz, corr(b, c) AS yz FROM rk GROUP BY subject)
 SELECT subject, n, round(CASE WHEN n >= 6 THEN (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) END, 6) AS r FROM co""")
def t9(spark, d):
    return r6(stats.partial_spearman(events(spark, d), ["subject"], "value", "k", "t_idx").select("subject", "n", "r"))


@query("t10_bootstrap_spearman", "WITH " + EVENTS + f""", m AS (SELECT subject, median(value) AS a, median(k) AS b FROM ev GROUP BY subject HAVING median(value) IS NOT NULL), ix AS (SELECT *, row_number() OVER (ORDER BY subject) - 1 AS i, count(*) OVER () AS n FROM m), dr AS (SELECT rep, ((({draw_sql(0, 'rep', 'subject', 'boot')})::UHUGEINT * n::UHUGEINT) >> 32)::BIGINT AS i FROM ix, {BOOT_REP}),
 sm AS (SELECT rep, a, b FROM dr JOIN ix USING (i)), rk AS (SELECT rep, {_rank('a', 'rep')} AS ra, {_rank('b', 'rep')} AS rb FROM sm), s AS (SELECT rep, corr(ra, rb) AS s FROM rk GROUP BY rep) SELECT 'all' AS grp, round(quantile_cont(s, 0.025), 6) AS ci_low, round(quantile_cont(s, 0.975), 6) AS ci_high, round(stddev_samp(s), 6) AS se FROM s""")
def t10(spark, d):
    m = events(spark, d).groupBy("subject").agg(F.median("value").alias("a"), F.median("k").alias("b")).withColumn("grp", F.lit("all"))
    return r6(stats.bootstrap_spearman(m, ["grp"], "a", "b", "subject", BOOTSTRAPS).drop("excludes_zero"))


WIL = """SELECT contrast_name, metric, count(*) AS n, round(least(coalesce(sum(rk) FILTER (diff > 0), 0), coalesce(sum(rk) FILTER (diff < 0), 0)), 6) AS w FROM (SELECT *, rank() OVER (PARTITION BY contrast_name, metric ORDER BY a) + (count(*) OVER (PARTITION BY contrast_name, metric, a) - 1) / 2.0::DOUBLE AS rk FROM (SELECT *, round(abs(diff), 9) AS a FROM df WHERE diff <> 0)) GROUP BY ALL"""


@query("t11_wilcoxon", "WITH " + COLLAPSED + " " + WIL)
def t11(spark, d):
    return r6(stats.wilcoxon(_diffs(spark, d), ["contrast_name", "metric"], p=False, large=True).select("contrast_name", "metric", "n", "w"))


@query("t11_wilcoxon_p")
def t11p(spark, d):
    return r6(stats.wilcoxon(_diffs(spark, d), ["contrast_name", "metric"], large=True))


@query("t12_friedman", "WITH " + LONG + f""", cm AS (SELECT metric, subject, condition, avg(value) AS v FROM lm WHERE condition IN ('view', 'click', 'error') AND ok GROUP BY ALL), fl AS (SELECT * FROM cm WHERE v IS NOT NULL AND (metric, subject) IN (SELECT (metric, subject) FROM cm WHERE v IS NOT NULL GROUP BY metric, subject HAVING count(*) = 3)),
 rk AS (SELECT metric, condition, {_rank('v', 'metric, subject')} AS r, count(*) OVER (PARTITION BY metric, subject, v) AS t FROM fl), sm AS (SELECT metric, condition, sum(r) AS s, count(*) AS n, sum(t * t - 1) AS ties FROM rk GROUP BY ALL)
 SELECT metric, max(n) AS n, round((12.0::DOUBLE / (max(n) * 12) * sum(s * s) - 3 * max(n) * 4) / (1 - sum(ties) / (max(n) * 24)), 6) AS chi2 FROM sm GROUP BY metric""")
def t12(spark, d):
    m = long_metrics(spark, d).where("ok and condition in ('view', 'click', 'error')").groupBy("metric", "subject", "condition").agg(mean_in_order(F.col("value"), F.col("event_id")).alias("v"))
    return r6(stats.friedman(m, ["metric"], "subject", "condition", "v", 3, p=False))


@query("t12_friedman_p")
def t12p(spark, d):
    m = long_metrics(spark, d).where("ok and condition in ('view', 'click', 'error')").groupBy("metric", "subject", "condition").agg(mean_in_order(F.col("value"), F.col("event_id")).alias("v"))
    return r6(stats.friedman(m, ["metric"], "subject", "condition", "v", 3))


@query("t13_one_sample_t", "WITH " + COLLAPSED + " SELECT contrast_name, metric, count(diff) AS n, round(avg(diff), 6) AS mean, round(stddev_samp(diff), 6) AS sd, round(stddev_samp(diff) / sqrt(count(diff)), 6) AS sem, round(avg(diff) / stddev_samp(diff), 6) AS dz, round(avg(diff) / (stddev_samp(diff) / sqrt(count(diff))), 6) AS t FROM df GROUP BY ALL")
def t13(spark, d):
    return r6(stats.one_sample(_diffs(spark, d), ["contrast_name", "metric"], "diff", p=False))


@query("t13_one_sample_p")
def t13p(spark, d):
    return r6(stats.one_sample(_diffs(spark, d), ["contrast_name", "metric"], "diff"))


@query("t14_median_sign", "WITH " + COLLAPSED + f""", s AS (SELECT contrast_name, metric, rep, median({flip_sql(0, 'rep', 'subject')} * diff) AS s, median(diff) AS o FROM df, {REP} GROUP BY ALL) SELECT contrast_name, metric, round(avg((abs(s) >= abs(o) - 1e-9)::INT), 6) AS p FROM s GROUP BY ALL""")
def t14(spark, d):
    return r6(stats.median_sign_p(_diffs(spark, d), ["contrast_name", "metric"], "diff", "subject", PERMUTATIONS))


@query("t15_leave_one_out", "WITH " + EVENTS + f""", m AS (SELECT condition, subject, median(value) AS a, median(k) AS b FROM ev GROUP BY ALL), lo AS (SELECT x.condition, y.subject AS o, x.a, x.b FROM m x JOIN m y ON x.condition = y.condition AND x.subject <> y.subject), rk AS (SELECT condition, o, {_rank('a', 'condition, o')} AS ra, {_rank('b', 'condition, o')} AS rb FROM lo WHERE a IS NOT NULL AND b IS NOT NULL),
 s AS (SELECT condition, o, corr(ra, rb) AS r FROM rk GROUP BY ALL) SELECT condition, round(avg(r), 6) AS mean_r, round(min(r), 6) AS min_r, round(max(r), 6) AS max_r, min(sign(r)) = max(sign(r)) AS sign_consistent, count(r) AS n_fits FROM s GROUP BY condition""")
def t15(spark, d):
    m = events(spark, d).groupBy("condition", "subject").agg(F.median("value").alias("a"), F.median("k").alias("b"))
    return r6(stats.leave_one_out(m, ["condition"], "subject", "a", "b"))


GRID = "WITH " + EVENTS + f""", g AS (SELECT condition, subject, median(value) AS a1, median(k) AS a2, avg(value) AS b1, max(k)::DOUBLE AS b2 FROM ev GROUP BY ALL), l AS (SELECT condition, subject, unnest(['a1', 'a2']) AS x, unnest([a1, a2]) AS vx FROM g), r AS (SELECT condition, subject, unnest(['b1', 'b2']) AS y, unnest([b1, b2]) AS vy FROM g),
 rk AS (SELECT condition, x, y, {_rank('vx', 'condition, x, y')} AS ra, {_rank('vy', 'condition, x, y')} AS rb FROM l JOIN r USING (condition, subject) WHERE vx IS NOT NULL AND vy IS NOT NULL) SELECT condition, x, y, count(*) AS n, round(corr(ra, rb), 6) AS r FROM rk GROUP BY ALL"""


@query("t16_correlation_grid", GRID)
def t16(spark, d):
    g = events(spark, d).groupBy("condition", "subject").agg(F.median("value").alias("a1"), F.median("k").alias("a2"), mean_in_order(F.col("value"), F.col("event_id")).alias("b1"), F.max("k").cast("double").alias("b2"))
    return r6(op.correlation_grid(g, g, ["condition", "subject"], ["a1", "a2"], ["b1", "b2"], ["condition"]).select("condition", "x", "y", "n", "r"))


@query("t17_within_session", "WITH " + EVENTS + f", rk AS (SELECT condition, subject, {_rank('value', 'condition, subject')} AS a, {_rank('k', 'condition, subject')} AS b FROM ev WHERE value IS NOT NULL), s AS (SELECT condition, subject, corr(a, b) AS r FROM rk GROUP BY ALL HAVING count(*) >= 10 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0) SELECT condition, count(*) AS n_sessions, sum((round(r, 9) > 0)::INT)::BIGINT AS n_positive, round(median(r), 6) AS median_r FROM s GROUP BY condition")
def t17(spark, d):
    return r6(op.within_session_correlation(events(spark, d), "subject", ["condition"], "value", "k").select("condition", "n_sessions", "n_positive", "median_r"))


@query("t18_pairwise", "WITH " + LONG + """, m AS (SELECT metric, subject, condition, avg(value) AS v FROM lm GROUP BY ALL), df AS (SELECT x.metric, x.condition AS a, y.condition AS b, y.v - x.v AS diff FROM m x JOIN m y ON x.metric = y.metric AND x.subject = y.subject AND x.condition < y.condition),
 w AS (SELECT metric, a, b, least(coalesce(sum(rk) FILTER (diff > 0), 0), coalesce(sum(rk) FILTER (diff < 0), 0)) AS w FROM (SELECT *, rank() OVER (PARTITION BY metric, a, b ORDER BY z) + (count(*) OVER (PARTITION BY metric, a, b, z) - 1) / 2.0::DOUBLE AS rk FROM (SELECT *, round(abs(diff), 9) AS z FROM df WHERE diff <> 0)) GROUP BY ALL HAVING count(*) >= 5)
 SELECT metric, a, b, count(diff) AS n_pairs, round(avg(diff) / (stddev_pop(diff) + 1e-12), 6) AS dz, round(any_value(w), 6) AS w FROM df LEFT JOIN w USING (metric, a, b) GROUP BY metric, a, b""")
def t18(spark, d):
    m = long_metrics(spark, d).groupBy("metric", "subject", "condition").agg(mean_in_order(F.col("value"), F.col("event_id")).alias("v"))
    return r6(op.pairwise_tests(m, ["metric"], "subject", "condition", "v").select("metric", "a", "b", "n_pairs", "dz", "w"))


CONF = "WITH " + EVENTS + f""", g AS (SELECT subject, median(value) FILTER (condition = 'view') - median(value) FILTER (condition = 'click') AS mg, median(k) FILTER (condition = 'view') - median(k) FILTER (condition = 'click') AS kg, median(t_idx) FILTER (condition = 'view') - median(t_idx) FILTER (condition = 'click') AS tg FROM ev GROUP BY subject),
 u AS (SELECT 'k' AS confound, kg AS c, mg FROM g UNION ALL SELECT 'position', tg, mg FROM g), rk AS (SELECT confound, {_rank('c', 'confound')} AS a, {_rank('mg', 'confound')} AS b FROM u WHERE c IS NOT NULL AND mg IS NOT NULL) SELECT confound, count(*) AS n, round(corr(a, b), 6) AS r FROM rk GROUP BY confound"""


@query("t19_confounds", CONF)
def t19(spark, d):
    e = events(spark, d)
    return r6(op.confound_table({"k": (e, "k"), "position": (e, "t_idx")}, (e, "value"), "subject", "condition", ("click", "view")).select("confound", "n", "r"))


@query("t20_contrast_driver")
def t20(spark, d):
    return r6(op.drive(long_metrics(spark, d), _contrasts(spark), ["metric"], "subject", PERMUTATIONS, BOOTSTRAPS, "event_id"))


DZ = "coalesce(avg({0}) / nullif(stddev_samp({0}), 0), 0)"
NULLS = "max(o) AS o, quantile_cont(s, 0.025) AS a, quantile_cont(s, 0.5) AS b, quantile_cont(s, 0.975) AS c, avg((abs(s) >= abs(o) - 1e-9)::INT) AS x"
ROUNDED = "round(o, 6) AS observed_dz, round(a, 6) AS null_low, round(b, 6) AS null_median, round(c, 6) AS null_high, round(x, 6) AS exceedance"


@query("t21_stage_control", "WITH " + EVENTS + f""", m AS (SELECT subject, condition, avg(value) AS v FROM ev GROUP BY ALL), ob AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY condition) AS k FROM m), og AS (SELECT subject, max(v) FILTER (k = 1) - max(v) FILTER (k = 3) AS g FROM ob GROUP BY subject), oz AS (SELECT {DZ.format('g')} AS o FROM og),
 sh AS (SELECT rep, subject, v, row_number() OVER (PARTITION BY subject, rep ORDER BY {draw_sql(0, 'rep', "concat_ws(':', subject::VARCHAR, condition)", 'stage')}, condition) AS k FROM m, {REP}), sg AS (SELECT rep, subject, max(v) FILTER (k = 1) - max(v) FILTER (k = 3) AS g FROM sh GROUP BY ALL), sz AS (SELECT rep, {DZ.format('g')} AS s FROM sg GROUP BY rep)
 SELECT 'all' AS grp, {ROUNDED} FROM (SELECT {NULLS} FROM sz, oz)""")
def t21(spark, d):
    m = events(spark, d).groupBy("subject", "condition").agg(F.avg("value").alias("v")).withColumn("grp", F.lit("all"))
    return r6(op.stage_control(m, ["grp"], "subject", "condition", "v", PERMUTATIONS))


@query("t22_sign_control", "WITH " + COLLAPSED + f""", sx AS (SELECT contrast_name, metric, rep, {flip_sql(0, 'rep', 'subject')} * diff AS z, diff FROM df, {REP}), s AS (SELECT contrast_name, metric, rep, {DZ.format('z')} AS s, {DZ.format('diff')} AS o FROM sx GROUP BY ALL) SELECT contrast_name, metric, {ROUNDED} FROM (SELECT contrast_name, metric, {NULLS} FROM s GROUP BY ALL)""")
def t22(spark, d):
    return r6(op.sign_control(_diffs(spark, d), ["contrast_name", "metric"], "subject", PERMUTATIONS))


@query("t23_event_bins", "WITH " + EVENTS + " SELECT subject, condition, k % 3 AS bin, count(*) AS n_windows, count(DISTINCT t_idx % 10) AS n_events, count(value) AS n_finite, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std FROM ev GROUP BY ALL")
def t23(spark, d):
    e = events(spark, d).withColumn("bin", F.col("k") % 3).withColumn("ev", F.col("t_idx") % 10)
    return r6(op.bin_descriptives(e, ["subject", "condition", "bin"], "ev", "value"))


@query("t24_baseline_deltas", "WITH " + EVENTS + """, b AS (SELECT subject, condition, avg(value) AS value, avg(k) AS k FROM ev GROUP BY ALL), l AS (SELECT subject, condition, unnest(['value', 'k']) AS metric, unnest([value, k]) AS v FROM b)
 SELECT x.subject, x.condition, x.metric, round(x.v - y.v, 6) AS delta FROM l x JOIN l y ON x.subject = y.subject AND x.metric = y.metric AND y.condition = 'view' WHERE x.condition <> 'view'""")
def t24(spark, d):
    b = events(spark, d).groupBy("subject", "condition").agg(F.avg("value").alias("value"), F.avg("k").alias("k"))
    return r6(op.baseline_deltas(b, ["subject"], "condition", "view", ["value", "k"]))


@query("t25_auc", f"WITH x AS (SELECT quality, n_chars, lang FROM labels JOIN documents USING (doc_id)), rk AS (SELECT lang, quality, {_rank('n_chars', 'lang')} AS r FROM x) SELECT lang, round((sum(r) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0) / nullif(sum(quality) * (count(*) - sum(quality)), 0), 6) AS auc, count(*) AS n FROM rk GROUP BY lang")
def t25(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return r6(stats.auc(x, ["lang"], "n_chars", "quality"))


@query("t25_incremental_auc")
def t25b(spark, d):
    from tideline.operators.models import incremental_auc

    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    x = x.select("doc_id", "quality", F.col("n_chars").cast("double").alias("n_chars"), F.col("toxic").cast("double").alias("toxic"))
    return r6(incremental_auc(x, "doc_id", "quality", ["n_chars"], ["toxic"], 5))


@query("t26_event_density", "WITH " + EVENTS + f""", c AS (SELECT v.subject, v.event_id, any_value(v.k)::DOUBLE AS k, count(p.event_id) AS n FROM ev v LEFT JOIN ev p ON p.condition = 'purchase' AND p.subject = v.subject AND p.time >= v.time AND p.time < v.time + 36000 WHERE v.condition = 'view' GROUP BY ALL), rk AS (SELECT 'all' AS grp, {_rank('n', '1')} AS a, {_rank('k', '1')} AS b FROM c) SELECT grp, count(*) AS n, round(corr(a, b), 6) AS r FROM rk GROUP BY grp""")
def t26(spark, d):
    e = events(spark, d)
    v, p = e.where("condition = 'view'").select("subject", "event_id", "time", "k"), e.where("condition = 'purchase'")
    n = joins.interval_count(v, p, "subject", "time", 36000.0, "time", "event_id").withColumn("grp", F.lit("all"))
    return r6(stats.spearman(n, ["grp"], "n_inside", "k", 20, large=True))


@query("t27_line_fit", "WITH " + EVENTS + " SELECT subject, round(regr_slope(value, k::DOUBLE), 6) AS slope, round(regr_intercept(value, k::DOUBLE), 6) AS intercept FROM ev GROUP BY subject")
def t27(spark, d):
    return r6(events(spark, d).withColumn("k", F.col("k").cast("double")).groupBy("subject").agg(F.regr_slope("value", "k").alias("slope"), F.regr_intercept("value", "k").alias("intercept")))
