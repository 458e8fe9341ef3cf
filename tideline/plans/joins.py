"""Queries of the join operators."""

from pyspark.sql import functions as F

from tideline.operators import joins as op
from tideline.plans.registry import query
from tideline.plans.shapes import EVENTS, TRAJECTORY, events, r6, table, trajectory

HOUR = 36000.0


@query("j1_null_safe_join", "WITH " + EVENTS + """, a AS (SELECT nullif(subject, 3) AS subject, condition, avg(value) AS left_value FROM ev GROUP BY ALL), b AS (SELECT nullif(o_custkey, 3) AS subject, CASE o_orderstatus WHEN 'F' THEN 'view' WHEN 'O' THEN 'click' ELSE 'error' END AS condition, max(o_totalprice) AS right_price FROM orders GROUP BY ALL)
 SELECT a.subject, a.condition, round(left_value, 6) AS left_value, round(right_price, 6) AS right_price FROM a JOIN b ON a.subject IS NOT DISTINCT FROM b.subject AND a.condition IS NOT DISTINCT FROM b.condition""")
def j1(spark, d):
    a = events(spark, d).groupBy(F.expr("nullif(subject, 3)").alias("subject"), "condition").agg(F.avg("value").alias("left_value"))
    status = F.when(F.col("o_orderstatus") == "F", "view").when(F.col("o_orderstatus") == "O", "click").otherwise("error")
    b = table(spark, d, "orders").groupBy(F.expr("nullif(o_custkey, 3)").alias("subject"), status.alias("condition")).agg(F.max("o_totalprice").alias("right_price"))
    return r6(op.null_safe(a, b, ["subject", "condition"]))


@query("j2_merge_chain", """WITH a AS (SELECT user_id AS subject, count(*) AS n_events FROM events GROUP BY user_id), b AS (SELECT o_custkey AS subject, count(*) AS n_orders FROM orders GROUP BY o_custkey), c AS (SELECT c_custkey AS subject, count(*) AS n_customers FROM customer GROUP BY c_custkey),
 j AS (SELECT s_suppkey AS subject, count(*) AS n_suppliers FROM supplier GROUP BY s_suppkey) SELECT subject, n_events, n_orders, n_customers, n_suppliers FROM a FULL JOIN b USING (subject) JOIN c USING (subject) LEFT JOIN j USING (subject)""")
def j2(spark, d):
    n = lambda name, key, out: table(spark, d, name).groupBy(F.col(key).alias("subject")).agg(F.count(F.lit(1)).alias(out))
    out = op.null_safe(n("events", "user_id", "n_events"), n("orders", "o_custkey", "n_orders"), ["subject"], "full")
    return op.null_safe(op.null_safe(out, n("customer", "c_custkey", "n_customers"), ["subject"]), n("supplier", "s_suppkey", "n_suppliers"), ["subject"], "left")


@query("j3_paired_join", "WITH " + EVENTS + """ SELECT * FROM (SELECT subject, round(avg(value) FILTER (condition = 'view'), 6) AS "left", round(avg(value) FILTER (condition = 'purchase'), 6) AS "right" FROM ev GROUP BY subject) WHERE "left" IS NOT NULL AND "right" IS NOT NULL""")
def j3(spark, d):
    return r6(op.paired(events(spark, d), ["subject"], F.col("condition") == "view", F.col("condition") == "purchase"))


ASOF = "WITH " + EVENTS + """, v AS (SELECT * FROM ev WHERE condition = 'view'), p AS (SELECT * FROM ev WHERE condition = 'purchase'),
 c AS (SELECT v.event_id, p.time AS near_time, p.event_id AS near_event_id, row_number() OVER (PARTITION BY v.event_id ORDER BY abs(p.time - v.time), p.time, p.event_id) AS n FROM v JOIN p ON v.subject = p.subject AND abs(p.time - v.time) <= 36000)
 SELECT v.event_id, round(c.near_time, 3) AS near_time, c.near_event_id FROM v LEFT JOIN c ON v.event_id = c.event_id AND c.n = 1"""


@query("j4_asof_nearest", ASOF)
def j4(spark, d):
    e = events(spark, d)
    v, p = (e.where(F.col("condition") == c).select("subject", "event_id", "time") for c in ("view", "purchase"))
    out = op.asof_nearest(v, p, "subject", "time", "time", HOUR, "event_id", ["event_id"])
    return out.select("event_id", F.round("near_time", 3).alias("near_time"), "near_event_id")


@query("j5_interval_count", "WITH " + EVENTS + """ SELECT v.event_id, count(p.event_id) AS n_inside FROM ev v LEFT JOIN ev p ON p.condition = 'purchase' AND p.subject = v.subject AND p.time >= v.time AND p.time < v.time + 36000 WHERE v.condition = 'view' GROUP BY v.event_id""")
def j5(spark, d):
    e = events(spark, d)
    v, p = (e.where(F.col("condition") == c).select("subject", "event_id", "time") for c in ("view", "purchase"))
    return op.interval_count(v, p, "subject", "time", HOUR, "time", "event_id").select("event_id", "n_inside")


@query("j6_index_lookup", "WITH " + EVENTS + " SELECT w.subject, w.t_idx AS w_idx, w.k AS center, s.condition AS stage FROM ev w JOIN ev s ON w.subject = s.subject AND s.t_idx = w.k")
def j6(spark, d):
    e = events(spark, d)
    w = e.select("subject", F.col("t_idx").alias("w_idx"), F.col("k").cast("long").alias("center"))
    return op.lookup(w, e.select("subject", "t_idx", F.col("condition").alias("stage")), "subject", "center", "t_idx").withColumn("center", F.col("center").cast("int"))


@query("j7_nearest_window", "WITH " + EVENTS + """, c AS (SELECT a.event_id, b.t_idx AS near_t_idx, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.t_idx - a.t_idx), b.t_idx) AS n FROM ev a JOIN ev b ON a.subject = b.subject AND b.condition = 'error' AND abs(b.t_idx - a.t_idx) <= 4)
 SELECT e.event_id, near_t_idx FROM ev e LEFT JOIN c ON e.event_id = c.event_id AND n = 1""")
def j7(spark, d):
    e = events(spark, d).select("subject", "event_id", "t_idx", "condition")
    return op.asof_nearest(e, e.where("condition = 'error'").select("subject", "t_idx"), "subject", "t_idx", "t_idx", 4, "event_id", []).select("event_id", "near_t_idx")


@query("j8_annotation", """SELECT o_orderkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE o_orderstatus END AS condition, o_orderstatus AS condition_original, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS depth FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def j8(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("condition"))
    notes = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("condition"), F.col("c_nationkey").alias("depth"))
    once = op.annotate(o, notes, ["subject"])
    return op.annotate(once, notes, ["subject"]).select("o_orderkey", "condition", "condition_original", "depth")


@query("j9_knn", "WITH " + TRAJECTORY + """, p AS (SELECT a.session, a.t_idx, b.t_idx AS neighbour, round((a.m - b.m)**2 + (a.d - b.d)**2 + (a.e - b.e)**2, 9) AS dist2 FROM tr a JOIN tr b ON a.session = b.session),
 r AS (SELECT *, row_number() OVER (PARTITION BY session, t_idx ORDER BY dist2, neighbour) AS rank FROM p) SELECT session, t_idx, neighbour, round(dist2, 6) AS dist2, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def j9(spark, d):
    return r6(op.neighbours(trajectory(spark, d, 3), ["session"], "t_idx", ["m", "d", "e"], 5))


@query("j10_pair_distance", "WITH " + TRAJECTORY + """ SELECT a.session, round(avg(sqrt((a.m - b.m)**2 + (a.d - b.d)**2 + (a.e - b.e)**2)), 6) AS mean_dist, round(max(sqrt((a.m - b.m)**2 + (a.d - b.d)**2 + (a.e - b.e)**2)), 6) AS max_dist FROM tr a JOIN tr b ON a.session = b.session AND a.t_idx < b.t_idx GROUP BY a.session""")
def j10(spark, d):
    return r6(op.pair_distances(trajectory(spark, d, 3), "session", "t_idx", ["m", "d", "e"]))


@query("j11_window_stage", "WITH " + EVENTS + """ SELECT v.event_id, coalesce(max_by(p.k, p.event_id), -1) AS stage FROM ev v LEFT JOIN ev p ON p.condition = 'purchase' AND p.subject = v.subject AND p.time >= v.time AND p.time < v.time + 36000 WHERE v.condition = 'view' GROUP BY v.event_id""")
def j11(spark, d):
    e = events(spark, d)
    v, p = e.where("condition = 'view'").select("subject", "event_id", "time"), e.where("condition = 'purchase'")
    return op.stage_of_windows(v, p, "subject", "time", HOUR, "time", "event_id", "k", "event_id").select("event_id", "stage")


@query("j12_semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j12(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return op.listed(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey")
