"""Queries of the metric-model operators."""

from pyspark.sql import functions as F

from tideline.functions.scalars import mean_in_order, rounded
from tideline.operators import metrics as op
from tideline.plans.registry import query
from tideline.plans.shapes import EVENTS, TRAJECTORY, events, r6, table, trajectory


@query("d1_melt", "SELECT o_orderkey, o_orderstatus, 'o_totalprice' AS metric, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, 'o_custkey', o_custkey::DOUBLE FROM orders")
def d1(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey", "o_orderpriority")
    return op.melt(o, ["o_orderkey", "o_orderstatus"])


METRICS = ["n_windows", "m_finite_frac", "pred_err_h1", "tube_kappa", "block_trace", "trace_mean", "speed_mean", "m_tau_sec", "alpha_power", "hrv"]


@query("d2_role_family", "SELECT c_custkey, metric, CASE WHEN metric IN ('n_windows') OR metric LIKE '%\\_finite\\_frac' ESCAPE '\\' OR metric LIKE 'pred\\_err\\_%' ESCAPE '\\' THEN 'qc' ELSE 'signal' END AS metric_role, CASE WHEN metric = 'tube_kappa' THEN 'reachability' WHEN metric = 'block_trace' THEN 'block' WHEN contains(metric, 'trace') THEN 'jacobian' WHEN contains(metric, 'speed') OR contains(metric, '_tau_sec') THEN 'trajectory' ELSE split_part(metric, '_', 1) END AS metric_family FROM (SELECT c_custkey, [" + ", ".join(f"'{m}'" for m in METRICS) + "][c_custkey % 10 + 1] AS metric FROM customer)")
def d2(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.array(*[F.lit(m) for m in METRICS])[(F.col("c_custkey") % 10).cast("int")].alias("metric"))
    return op.role_and_family(c)


def long(spark, d):
    return events(spark, d).select("subject", (F.col("k") % 3).alias("condition"), F.col("condition").alias("metric"), "value", "event_id")


LONG = EVENTS + ", lg AS (SELECT subject, k % 3 AS condition, condition AS metric, value, event_id FROM ev)"


def _first(names, out):
    order = "CASE metric " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names)) + " END"
    listed = ", ".join(f"'{n}'" for n in names)
    return f"SELECT subject, condition, value AS {out} FROM (SELECT *, row_number() OVER (PARTITION BY subject, condition ORDER BY {order}, event_id) AS n FROM lg WHERE metric IN ({listed}) AND value IS NOT NULL) WHERE n = 1"


JOINED = LONG + f", sp AS ({_first(['click', 'view'], 'speed')}), ro AS ({_first(['purchase'], 'rotation')}), an AS ({_first(['error'], 'anisotropy')})"


def _z(c):
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {c}_ma > 1e-12 THEN ({c} - {c}_me) / {c}_ma WHEN {c}_sd > 1e-12 THEN ({c} - {c}_me) / {c}_sd ELSE 0 END"


ST = ", ".join(f"median({c}) AS {c}_me, mad({c}) AS {c}_ma, stddev_pop({c}) AS {c}_sd" for c in ("speed", "rotation", "anisotropy"))


@query("d3_adaptive_index", "WITH " + JOINED + f", j AS (SELECT subject, condition, speed, rotation, anisotropy FROM sp JOIN ro USING (subject, condition) LEFT JOIN an USING (subject, condition)), s AS (SELECT condition, {ST} FROM j GROUP BY condition), z AS (SELECT subject, condition, {_z('speed')} AS zs, {_z('rotation')} AS zr, {_z('anisotropy')} AS za FROM j JOIN s USING (condition)) SELECT subject, condition, round(zs + zr, 6) AS reduced, round(zs + zr - za, 6) AS full FROM z".replace(" AS full", ' AS "full"'))
def d3(spark, d):
    return r6(op.adaptive_index(long(spark, d), ["subject", "condition"], ["condition"], "event_id", ["click", "view"], "purchase", "error").select("subject", "condition", "reduced", "full"))


@query("d4_asymmetry", "WITH " + LONG + """, w AS (SELECT subject, condition, min(value) FILTER (metric = 'view') AS a, min(value) FILTER (metric = 'click') AS b, min(value) FILTER (metric = 'error') AS c FROM lg GROUP BY ALL), p AS (SELECT subject, condition, abs(a - b) / (abs(a) + abs(b) + 1e-12) AS p1, abs(b - c) / (abs(b) + abs(c) + 1e-12) AS p2, abs(a - c) / (abs(a) + abs(c) + 1e-12) AS p3 FROM w)
 SELECT subject, condition, round(CASE WHEN p1 IS NOT NULL OR p2 IS NOT NULL OR p3 IS NOT NULL THEN coalesce(p1, 0) + coalesce(p2, 0) + coalesce(p3, 0) END, 6) AS asymmetry FROM p""")
def d4(spark, d):
    return r6(op.asymmetry(long(spark, d), ["subject", "condition"], [("view", "click"), ("click", "error"), ("view", "error")]))


@query("d5_aliases", "WITH " + LONG + " SELECT subject, condition, metric, value FROM (SELECT *, row_number() OVER (PARTITION BY subject, condition, metric ORDER BY event_id) AS n FROM (SELECT subject, condition, CASE metric WHEN 'view' THEN 'looked' WHEN 'click' THEN 'looked' WHEN 'error' THEN 'failed' END AS metric, value, event_id FROM lg) WHERE metric IS NOT NULL) WHERE n = 1")
def d5(spark, d):
    return op.publish_aliases(long(spark, d), ["subject", "condition"], "event_id", {"view": "looked", "click": "looked", "error": "failed"}).select("subject", "condition", "metric", "value")


@query("d6_traversability", "WITH " + JOINED + ", j AS (SELECT subject, condition, speed, anisotropy, min(anisotropy) OVER (PARTITION BY subject) AS lo, max(anisotropy) OVER (PARTITION BY subject) AS hi FROM sp JOIN an USING (subject, condition)) SELECT subject, condition, round(speed * (1 - CASE WHEN hi > lo THEN (anisotropy - lo) / (hi - lo) ELSE 0 END), 6) AS traversability FROM j")
def d6(spark, d):
    return r6(op.traversability(long(spark, d), ["subject", "condition"], ["subject"], "event_id", ["click", "view"], "error").select("subject", "condition", "traversability"))


@query("d7_manifest_flatten", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS stats_k, 1.5::DOUBLE AS stats_tau_1 FROM events")
def d7(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"stats": '), F.regexp_replace("props", r"\}$", ', "tau": [0.5, 1.5]}'), F.lit("}")).alias("manifest"))
    return op.flatten_manifest(e, ["event_id"], "manifest", ["stats.k", "stats.tau[1]"])


@query("d7_manifest_explode", "SELECT event_id, 'k' AS metric, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events")
def d7b(spark, d):
    return op.explode_manifest(table(spark, d, "events"), ["event_id"], "props")


@query("d8_category_long", "SELECT c_custkey, c_mktsegment, 'c_acctbal' AS metric, c_acctbal AS value, 'balance' AS coordinate FROM customer UNION ALL SELECT c_custkey, c_mktsegment, 'c_nationkey', c_nationkey::DOUBLE, 'c_nationkey' FROM customer")
def d8(spark, d):
    return op.category_long(table(spark, d, "customer"), ["c_custkey", "c_mktsegment"], ["c_acctbal", "c_nationkey"], {"c_acctbal": "balance"})


EFF = EVENTS + ", ef AS (SELECT subject, condition, round(avg(value) - 10, 2) AS effect, CASE WHEN subject % 3 <> 0 THEN min(k) / 100.0::DOUBLE END AS q, (min(k) + 1) / 100.0::DOUBLE AS p FROM ev GROUP BY subject, condition)"


def effects(spark, d):
    return events(spark, d).groupBy("subject", "condition").agg(rounded(mean_in_order(F.col("value"), F.col("event_id")) - 10, 2).alias("effect"), F.when(F.col("subject") % 3 != 0, F.min("k") / 100.0).alias("q"), ((F.min("k") + 1) / 100.0).alias("p"))


CELL = "max(printf('%.2f', effect) || CASE WHEN coalesce(q, p) < 0.001 THEN '***' WHEN coalesce(q, p) < 0.01 THEN '**' WHEN coalesce(q, p) < 0.05 THEN '*' ELSE '' END)"


@query("d9_effect_matrix", "WITH " + EFF + f""" SELECT subject, {CELL} FILTER (condition = 'click') AS click, {CELL} FILTER (condition = 'view') AS "view" FROM ef GROUP BY subject""")
def d9(spark, d):
    return op.effect_matrix(effects(spark, d), "subject", "condition", ["click", "view"])


@query("d10_norms", "WITH " + TRAJECTORY + " SELECT session, t_idx, round(sqrt(x3*x3 + x4*x4 + x5*x5), 6) AS speed, round(sqrt(m*m + d*d + e*e), 6) AS norm FROM tr")
def d10(spark, d):
    return r6(op.norms(trajectory(spark, d), ["x3", "x4", "x5"], ["m", "d", "e"]).select("session", "t_idx", "speed", "norm"))


@query("d11_append", "WITH " + EVENTS + " SELECT subject, condition, value, NULL::BIGINT AS balance FROM ev UNION ALL SELECT c_custkey, NULL, NULL, round(c_acctbal)::BIGINT FROM customer")
def d11(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.round("c_acctbal").cast("long").alias("balance"))
    return op.append(events(spark, d).select("subject", "condition", "value"), c)


@query("d12_top_effects", "WITH " + EFF + " SELECT subject, condition, effect, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY abs(effect) DESC NULLS LAST, subject) AS place FROM ef) WHERE place <= 5")
def d12(spark, d):
    return op.top_effects(effects(spark, d), ["condition"], "effect", 5, "subject").select("subject", "condition", "effect", "place")


@query("d13_families", "WITH " + EFF + " SELECT 'main' AS family, count(effect) AS n, round(max(abs(effect)), 6) AS largest, round(median(abs(effect)), 6) AS median FROM ef WHERE condition = 'view' UNION ALL SELECT 'reference', count(effect), round(max(abs(effect)), 6), round(median(abs(effect)), 6) FROM ef WHERE condition = 'click'")
def d13(spark, d):
    e = effects(spark, d)
    return r6(op.compare_families(e.where("condition = 'view'"), e.where("condition = 'click'"), ("main", "reference"), "effect"))


@query("d14_best_available", "WITH " + EFF + ", r AS (SELECT *, CASE condition WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 WHEN 'view' THEN 3 END AS rk FROM (SELECT subject, condition, CASE WHEN (p * 100)::INT % 2 = 0 THEN p END AS p FROM ef)) SELECT subject, arg_min(condition, rk) AS condition, arg_min(p, rk) AS p FROM r WHERE rk IS NOT NULL AND p IS NOT NULL GROUP BY subject")
def d14(spark, d):
    e = effects(spark, d).withColumn("p", F.when(F.round(F.col("p") * 100).cast("int") % 2 == 0, F.col("p")))
    return op.best_available(e, ["subject"], "condition", "p", ["purchase", "error", "view"])
