"""Queries of the filter operators."""

from pyspark.sql import functions as F

from tideline.operators import filters as op
from tideline.plans.registry import query
from tideline.plans.shapes import EVENTS, events, r6, table


def flagged(spark, d):
    """Events with quality flags, some of them null."""
    k = F.col("k")
    return events(spark, d).select(
        "event_id", "subject", "condition", "value", "k",
        F.when(k % 5 != 0, k % 7 != 0).alias("finite_ok"), F.when(k % 3 != 0, k % 11 == 0).alias("not_testable"), F.when(k % 4 != 0, k % 13 == 0).alias("validity_limited"),
    )


FLAGGED = f"""WITH {EVENTS}, fl AS (SELECT event_id, subject, condition, value, k, CASE WHEN k % 5 <> 0 THEN k % 7 <> 0 END AS finite_ok,
 CASE WHEN k % 3 <> 0 THEN k % 11 = 0 END AS not_testable, CASE WHEN k % 4 <> 0 THEN k % 13 = 0 END AS validity_limited FROM ev) """


@query("f1_selector", "WITH " + EVENTS + " SELECT event_id, subject, condition FROM ev WHERE condition IN ('view', 'click') AND subject = 8")
def f1(spark, d):
    return op.select_rows(events(spark, d), {"condition": ["view", "click"], "subject": 8}).select("event_id", "subject", "condition")


@query("f2_qc_gate", FLAGGED + "SELECT event_id, value FROM fl WHERE coalesce(finite_ok, true) AND NOT coalesce(not_testable, false) AND NOT coalesce(validity_limited, false) AND value IS NOT NULL")
def f2(spark, d):
    return op.qc_gate(flagged(spark, d), exclude_limited=True).select("event_id", "value")


@query("f3_validity", FLAGGED + """SELECT event_id, concat_ws(';', CASE WHEN value IS NULL THEN 'value_nonfinite' END, CASE WHEN value < 2 THEN 'value_lt_2' END, CASE WHEN value > 30 THEN 'value_gt_30' END,
 CASE WHEN NOT coalesce(finite_ok, false) THEN 'finite_ok_false' END, CASE WHEN coalesce(not_testable, true) THEN 'not_testable_true' END, CASE WHEN validity_limited IS NULL THEN 'validity_limited_null' END, 'absent_missing') AS validity_reasons FROM fl""")
def f3(spark, d):
    rules = {"value": {"min": 2, "max": 30}, "finite_ok": {"require_true": True}, "not_testable": {"require_false": True}, "validity_limited": {"require_nonnull": True}, "absent": {"min": 0}}
    return op.validity(flagged(spark, d), rules).select("event_id", "validity_reasons")


@query("f4_window_mask", FLAGGED + """SELECT event_id, coalesce((k % 9 <> 0)::INT = 1 AND (value IS NULL OR value / 20 >= 0.3) AND (finite_ok IS NOT NULL)::INT + (not_testable IS NOT NULL)::INT + (validity_limited IS NOT NULL)::INT >= 2, false) AS window_ok FROM fl""")
def f4(spark, d):
    w = flagged(spark, d).withColumn("all_finite", (F.col("k") % 9 != 0).cast("int")).withColumn("support", F.col("value") / 20)
    return op.window_mask(w, "all_finite", "support", ["finite_ok", "not_testable", "validity_limited", "absent"], 0.3, 2).select("event_id", "window_ok")


@query("f5_support_mask", FLAGGED + "SELECT event_id FROM fl WHERE value IS NULL OR value >= 6")
def f5(spark, d):
    return op.window_mask(flagged(spark, d), "absent", "value", [], 6.0).where("window_ok").select("event_id")


LAYERS = """WITH ly AS (SELECT c_custkey AS session, l.layer, l.contract FROM customer, (VALUES ('a_cohort', 'cohort', 2), ('b_subject', 'subject', 3), ('c_legacy', 'legacy', 5), ('d_cohort', 'cohort', 7)) l(layer, contract, step) WHERE c_custkey % l.step = 0),
ss AS (SELECT c_custkey AS session, CASE WHEN c_custkey % 4 = 0 THEN 2.1 ELSE 1.0 END AS version, CASE WHEN c_custkey % 3 = 0 THEN 'd_cohort' ELSE 'b_subject' END AS primary_layer FROM customer),
rk AS (SELECT ly.*, CASE WHEN contract = '{0}' AND layer = primary_layer THEN 0 WHEN contract = '{0}' THEN 1 WHEN version < 2.1 THEN CASE contract {1} END END AS level FROM ly JOIN ss USING (session))
SELECT session, layer, contract AS resolved FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY level, layer) AS n FROM rk WHERE level IS NOT NULL) WHERE n = 1"""


def _layers(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("session"))
    of = F.array(*[F.struct(F.lit(a).alias("layer"), F.lit(b).alias("contract"), F.lit(s).alias("step")) for a, b, s in (("a_cohort", "cohort", 2), ("b_subject", "subject", 3), ("c_legacy", "legacy", 5), ("d_cohort", "cohort", 7))])
    layers = c.select("session", F.inline(of)).where("session % step = 0").drop("step")
    sessions = c.withColumn("version", F.when(F.col("session") % 4 == 0, 2.1).otherwise(1.0)).withColumn("primary_layer", F.when(F.col("session") % 3 == 0, "d_cohort").otherwise("b_subject"))
    return sessions, layers


@query("f6_coordinate_layer", LAYERS.format("cohort", "WHEN 'legacy' THEN 2 WHEN 'subject' THEN 3"))
def f6(spark, d):
    return op.choose_layer(*_layers(spark, d), "cohort", ["legacy", "subject"])


@query("f7_jacobian_layer", LAYERS.format("subject", "WHEN 'legacy' THEN 2"))
def f7(spark, d):
    return op.choose_layer(*_layers(spark, d), "subject", ["legacy"])


@query("f8_geometry_gate", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN o_totalprice END AS metric,
 concat_ws('; ', CASE WHEN o_orderkey % 5 = 0 THEN 'degenerate axes: m_a,d_n' END, CASE WHEN o_orderkey % 7 = 0 THEN 'no retained windows' END) AS reason, o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 AS not_testable FROM orders""")
def f8(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("metric"))
    o = o.withColumn("axes", F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("m_a"), F.lit("d_n"))).otherwise(F.array().cast("array<string>"))).withColumn("kept", F.col("o_orderkey") % 7)
    return op.gate_geometry(o, "axes", "kept", ["metric"]).select("o_orderkey", "metric", "reason", "not_testable")


@query("f9_rule_suppression", "WITH " + EVENTS + " SELECT event_id, condition FROM ev WHERE NOT (condition = 'view' AND k % 3 = 0) AND NOT (condition = 'error' AND k % 3 = 1)")
def f9(spark, d):
    e = events(spark, d).withColumn("modality", F.col("k") % 3)
    rules = e.where("(condition = 'view' and modality = 0) or (condition = 'error' and modality = 1)")
    return op.drop_disabled(e, rules, ["condition", "modality"]).select("event_id", "condition")


@query("f10_condition_coalesce", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'task') AS condition FROM orders")
def f10(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'F')").alias("condition"), F.lit("task").alias("task"))
    return op.fill_condition(o).select("o_orderkey", "condition")


@query("f11_falsified", "WITH " + EVENTS + " SELECT event_id FROM ev WHERE coalesce(CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN 1 ELSE 0 END, 0) <> 1")
def f11(spark, d):
    return op.drop_flagged(events(spark, d).withColumn("bad", F.expr("case when k % 3 = 0 then null when k % 3 = 1 then 1 else 0 end")), "bad").select("event_id")


@query("f12_intersection", "WITH " + EVENTS + """, c AS (SELECT subject, count(*) FILTER (condition = 'view') AS n_view, count(*) FILTER (condition = 'click') AS n_click, count(*) FILTER (condition = 'error') AS n_error FROM ev GROUP BY subject)
 SELECT subject, n_view, n_click, n_error, greatest(least(n_view, n_click, n_error), 10) AS min_rows FROM c WHERE least(n_view, n_click, n_error) > 0""")
def f12(spark, d):
    return op.intersection_sample(events(spark, d), ["view", "click", "error"])


@query("f13_category_bins", """SELECT c_custkey, CASE WHEN c_acctbal <= 1000 THEN 'low' ELSE 'high' END AS bin, c_mktsegment || ':' || (c_nationkey % 3)::VARCHAR AS category FROM customer WHERE (c_acctbal <= 1000 OR c_acctbal >= 5000) AND c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def f13(spark, d):
    c = op.select_rows(table(spark, d, "customer"), {"c_mktsegment": ["BUILDING", "MACHINERY"]})
    c = c.select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("group"), (F.col("c_nationkey") % 3).cast("string").alias("condition"))
    return op.binned_category(c, "c_acctbal", 1000, 5000).select("c_custkey", "bin", "category")


@query("f14_eligibility", "WITH " + EVENTS + """, r AS (SELECT subject, avg((k >= 50)::INT::DOUBLE) FILTER (condition = 'view') AS rate_view, avg((k >= 50)::INT::DOUBLE) FILTER (condition = 'click') AS rate_click FROM ev GROUP BY subject)
 SELECT subject, round(rate_view, 6) AS rate_view, round(rate_click, 6) AS rate_click, coalesce(rate_view >= 0.3 AND rate_click >= 0.3, false) AS eligible, coalesce(rate_view < 0.5 OR rate_click < 0.5, false) AS low FROM r""")
def f14(spark, d):
    return r6(op.eligibility(events(spark, d).withColumn("ok", F.col("k") >= 50), ("view", "click"), "ok"))


@query("f15_two_groups", """SELECT c_custkey, 'left' AS side FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 3 = 1 UNION ALL SELECT c_custkey, 'right' FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def f15(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("group"), (F.col("c_nationkey") % 3).cast("string").alias("condition"))
    return op.two_groups(c, ("BUILDING", "1"), ("MACHINERY", "absent")).select("c_custkey", "side")
