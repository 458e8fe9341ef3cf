"""Queries of the source and sink operators. Round trips through files are in the tests."""

from pyspark.sql import functions as F

from tideline.plans.registry import query
from tideline.plans.shapes import EVENTS, events, table
from tideline.sources import scan as op


@query("s1_parquet_scan", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 1 THEN o_totalprice END AS price FROM orders")
def s1(spark, d):
    o = op.read_parquet(spark, f"{d}/orders.parquet")
    price = F.when(F.col("o_orderkey") % 5 == 0, float("nan")).when(F.col("o_orderkey") % 5 == 1, float("inf")).otherwise(F.col("o_totalprice"))
    return op.clean_numbers(o.select("o_orderkey", price.alias("price")))


@query("s3_sidecar_fallback", "WITH " + EVENTS + " SELECT subject AS session, event_id, value FROM ev WHERE subject % 3 = 0 UNION ALL SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT subject FROM ev WHERE subject % 3 = 0)")
def s3(spark, d):
    e = events(spark, d).where("subject % 3 = 0").select(F.col("subject").alias("session"), "event_id", "value")  # sessions that have the first format
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("value"))
    return op.read_sidecars(e, o)


@query("s4_first_sessions", "WITH " + EVENTS + " SELECT subject, event_id FROM ev WHERE value IS NOT NULL AND subject IN (SELECT DISTINCT subject FROM ev WHERE value IS NOT NULL ORDER BY subject LIMIT 20)")
def s4(spark, d):
    return op.first_sessions(events(spark, d), "subject", 20, "value is not null").select("subject", "event_id")


FILES = "fl AS (SELECT o_orderkey, 'ds' || o_custkey % 9 || '_type_' || o_orderkey % 13 || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.parquet' AS file_name, CASE o_custkey % 3 WHEN 0 THEN '/cleaned/x' WHEN 1 THEN '/raw/x' ELSE '/other/x' END AS file_path, o_orderdate AS file_time, o_orderkey % 13 AS t, CASE o_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS c FROM orders)"


def files(spark, d):
    name = F.concat(F.lit("ds"), F.col("o_custkey") % 9, F.lit("_type_"), F.col("o_orderkey") % 13, F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd_HHmmss"), F.lit(".parquet"))
    path = F.array(F.lit("/cleaned/x"), F.lit("/raw/x"), F.lit("/other/x"))[(F.col("o_custkey") % 3).cast("int")]
    return table(spark, d, "orders").select("o_orderkey", name.alias("file_name"), path.alias("file_path"), F.col("o_orderdate").alias("file_time"))


@query("s5_latest_snapshot", "WITH " + FILES + " SELECT 'type_' || t AS type, file_name, c AS path_class FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY c, file_time DESC, file_name) AS n FROM fl) WHERE n = 1")
def s5(spark, d):
    return op.latest_snapshots(files(spark, d), classes=["/cleaned/", "/raw/"]).select("type", "file_name", "path_class")


@query("s6_latest_non_empty", "WITH " + FILES + " SELECT file_name FROM fl WHERE t = 4 AND o_orderkey % 4 > 0 ORDER BY file_time DESC, file_name LIMIT 1")
def s6(spark, d):
    f = files(spark, d).select(F.concat(F.lit("type_"), F.col("o_orderkey") % 13).alias("type"), "file_name", (F.col("o_orderkey") % 4).alias("n"), F.col("file_time").alias("stamp"))
    return op.latest_non_empty(f, "type_4", "n").select("file_name")


@query("s7_keys_from_name", "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 'sub-' || c_custkey END AS subject, 't' || c_nationkey % 3 AS raw_task, CASE c_nationkey % 3 WHEN 0 THEN 'rest' ELSE 't' || c_nationkey % 3 END AS task FROM customer")
def s7(spark, d):
    name = F.concat(F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("sub-"), "c_custkey")).otherwise("x"), F.lit("_task-t"), F.col("c_nationkey") % 3, F.lit("_eeg.h5"))
    return op.keys_from_name(table(spark, d, "customer").select("c_custkey", name.alias("f")), "f", {"t0": "rest"}).drop("f")


@query("s9_json_sidecar", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s9(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("s11_columnar_arrays", "SELECT vec_id, label, (i - 1)::INTEGER AS i, embedding[i]::DOUBLE AS a, embedding[i + 8]::DOUBLE AS b FROM embeddings, range(1, 9) r(i) WHERE vec_id % 7 <> 0")
def s11(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 8).cast("array<double>").alias("a"), F.slice("embedding", 9, F.when(F.col("vec_id") % 7 == 0, 5).otherwise(8)).cast("array<double>").alias("b"))
    return op.explode_columns(e, ["vec_id"], ["a", "b"], ["label"])


@query("s12_source_catalog", "SELECT DISTINCT s AS source FROM (SELECT 'src' || o_custkey % 50 AS s FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT 'src' || c_custkey % 70 FROM customer)")
def s12(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("src"), F.col("o_custkey") % 50)).alias("source"))
    c = table(spark, d, "customer").select(F.concat(F.lit("src"), F.col("c_custkey") % 70).alias("source"))
    return op.source_catalog([o, c], "source")


@query("s2_parquet_sink", "SELECT o_orderkey, o_totalprice, o_orderstatus AS analysis_type FROM orders")
def s2(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("analysis_type"))
    op.write_parquet(o, path := op.shared_folder(spark), ["analysis_type"])
    return op.read_parquet(spark, path, "o_orderkey bigint, o_totalprice double, analysis_type string")


@query("s8_event_tsv", "SELECT user_id::VARCHAR AS onset, event_type AS trial_type, event_id::VARCHAR AS k FROM events WHERE event_type LIKE 'c%'")
def s8(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("onset"), F.col("event_type").alias("trial_type"), F.col("event_id").cast("string").alias("k"))
    e.write.option("sep", "\t").option("header", True).csv(path := op.shared_folder(spark))
    return op.read_events(spark, path, "onset string, trial_type string, k string", prefix="c").select("onset", "trial_type", "k")


@query("s10_csv_sink", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def s10(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    op.write_csv(c, path := op.shared_folder(spark))
    return spark.read.schema(c.schema).option("header", True).csv(path)
