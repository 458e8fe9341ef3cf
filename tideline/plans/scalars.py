"""Queries of the scalar functions."""

from pyspark.sql import functions as F

from tideline.functions import scalars as fn
from tideline.plans.registry import query
from tideline.plans.shapes import table

TEXTS = [" Wake", "N2", "post_ROR", "", "other ", "3", "2.0", "yes", "OFF", "n/a", "-0.5", "7e1"]
PICK = "[" + ", ".join(f"'{t}'" for t in TEXTS) + "][c_custkey % 12 + 1]"
SRC = f"WITH s AS (SELECT c_custkey, {PICK} AS t, nullif(trim({PICK}), '') AS b, lower(trim({PICK})) AS l FROM customer)"
LABEL = "CASE lower(b) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fn.STAGES.items()) + " ELSE lower(b) END"


def texts(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.array(*[F.lit(t) for t in TEXTS])[(F.col("c_custkey") % 12).cast("int")].alias("t"))


@query("c1_stage_label", SRC + f" SELECT c_custkey, {LABEL} AS label FROM s")
def c1(spark, d):
    return texts(spark, d).select("c_custkey", fn.stage_label(F.col("t")).alias("label"))


CODE = "trunc(TRY_CAST(b AS DOUBLE))::INTEGER"


@query("c2_stage_code", SRC + f" SELECT c_custkey, {CODE} AS code FROM s")
def c2(spark, d):
    return texts(spark, d).select("c_custkey", fn.stage_code(F.col("t")).alias("code"))


BOOKS = ['{"1": "Wake", "2": "N2"}', '{"Wake": 1, "REM": 5}', '[{"code": 3, "label": "N3"}, {"id": "4", "name": "r"}]']


@query("c3_codebook", "SELECT c_custkey, b.code, b.label FROM customer, (VALUES (0, 1, 'awake'), (0, 2, 'nrem2'), (1, 1, 'awake'), (1, 5, 'rem'), (2, 3, 'nrem3'), (2, 4, 'rem')) b(k, code, label) WHERE c_custkey % 3 = b.k")
def c3(spark, d):
    book = F.array(*[F.lit(b) for b in BOOKS])[(F.col("c_custkey") % 3).cast("int")]
    return table(spark, d, "customer").select("c_custkey", F.explode(fn.codebook(book)).alias("code", "label"))


@query("c4_stage_identity", SRC + f" SELECT c_custkey, CASE WHEN {CODE} IS NOT NULL THEN CASE {CODE} WHEN 2 THEN 'nrem2' WHEN 70 THEN 'rem' END ELSE {LABEL} END AS stage FROM s")
def c4(spark, d):
    book = F.create_map(F.lit(2), F.lit("nrem2"), F.lit(70), F.lit("rem"))
    return texts(spark, d).select("c_custkey", fn.stage_identity(F.col("t"), book).alias("stage"))


@query("c5_metadata_pick", SRC + " SELECT c_custkey, coalesce(b, CASE WHEN c_custkey % 5 = 0 THEN 'attr' END, 'unknown') AS picked FROM s")
def c5(spark, d):
    return texts(spark, d).select("c_custkey", fn.first_known(F.col("t"), F.when(F.col("c_custkey") % 5 == 0, "attr"), F.lit("unknown")).alias("picked"))


@query("c6_medication_group", SRC + " SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Healthy' WHEN 1 THEN CASE WHEN TRY_CAST(l AS DOUBLE) > 0 THEN 'FEP medicated' ELSE 'FEP unmedicated' END END AS grp FROM s")
def c6(spark, d):
    group = F.array(F.lit("Control"), F.lit(" FEP "), F.lit("?"))[(F.col("c_custkey") % 3).cast("int")]
    return texts(spark, d).select("c_custkey", fn.medication_group(group, F.col("t")).alias("grp"))


@query("c7_feature_name", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'alpha' ELSE 'alpha_power' END AS base, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN 'grp' END AS region FROM customer")
def c7(spark, d):
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("alpha__g_"), "c_mktsegment")).otherwise("alpha_power")
    group = F.when(F.col("c_custkey") % 3 == 0, "grp").otherwise(" ")
    return table(spark, d, "customer").select("c_custkey", fn.feature_base(name).alias("base"), fn.feature_region(name, group).alias("region"))


@query("c8_depth_name", "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN 'sub-' || printf('%03d', c_custkey % 500) END AS subject, CASE WHEN c_custkey % 4 <> 0 THEN 'acq-' || c_custkey % 7 END AS acq, CASE WHEN c_custkey % 4 <> 0 THEN 'run-' || c_nationkey END AS run FROM customer")
def c8(spark, d):
    raw = F.concat((F.col("c_custkey") % 500).cast("string"), F.lit("-anest-20200101 "), F.when(F.col("c_custkey") % 4 != 0, F.concat((F.col("c_custkey") % 7).cast("string"), F.lit("."), F.col("c_nationkey").cast("string"))).otherwise("bad"))
    return table(spark, d, "customer").select("c_custkey", *[fn.depth_key(raw, p).alias(p) for p in ("subject", "acq", "run")])


@query("c9_coercion", SRC + " SELECT c_custkey, CASE WHEN l IN ('true', 'yes', 'y', 'on') THEN true WHEN l IN ('false', 'no', 'n', 'off', '') THEN false WHEN TRY_CAST(l AS DOUBLE) IS NOT NULL THEN abs(TRY_CAST(l AS DOUBLE)) >= 1 ELSE true END AS flag, TRY_CAST(nullif(l, 'n/a') AS DOUBLE) AS number FROM s")
def c9(spark, d):
    return texts(spark, d).select("c_custkey", fn.optional_bool(F.col("t")).alias("flag"), fn.optional_float(F.col("t")).alias("number"))


@query("c10_names", "SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^0-9A-Za-z_]+', '_', 'g'), '_'), ''), 'feature') AS col, coalesce(nullif(trim(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9_.\\-]+', '-', 'g'), '-{2,}', '-', 'g'), '-'), ''), 'unknown') AS token FROM pages")
def c10(spark, d):
    return table(spark, d, "pages").select("page_id", fn.column_safe(F.col("url")).alias("col"), fn.token_safe(F.col("url")).alias("token"))
