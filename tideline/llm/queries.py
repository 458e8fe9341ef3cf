"""The registered queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from tideline.llm import decontaminate, jaccard, licenses, line_dedup, merkle, mixing, quality, resample, sharding, tiff, toxicity, urls, warc
from tideline.llm.common import table

CATEGORIES = ["low_quality", "toxic"]


def labels_of(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op1_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), entropy=0.97, repeats=4, ids_only=True)


def op5_sharding(spark, sf_dir):
    out = sharding.assign(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_tiff(spark, sf_dir):
    return tiff.digest_pages(tiff.tiff_pages(tiff.to_tiff(table(spark, sf_dir, "documents"))))


def op8_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), labels_of(spark, sf_dir), CATEGORIES)


def op9_jaccard_join(spark, sf_dir):
    return jaccard.Join(k=4, percent=85).classes(table(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    return warc.read_records(warc.write_bundles(table(spark, sf_dir, "pages")))


def op11_merkle(spark, sf_dir):
    return merkle.verified(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark, sf_dir):
    out = quality.judge(table(spark, sf_dir, "documents"))
    base_failed = F.arrays_overlap("failed", F.array(*[F.lit(x) for x in sorted(quality.BASE)]))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept", F.array_join("failed", ",").alias("failed"))


def op13_resample(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries():
    out = {name: f for name, f in globals().items() if name.startswith("op")}
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    from tideline.llm import oracles

    return oracles.SQL
