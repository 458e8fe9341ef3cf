r"""Target-distribution importance resampling: documents drawn by how much their words resemble a target's.

Features are runs of 1 to ``grams`` consecutive words (lower-cased A-Z, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``), each in
the bucket crc32 modulo ``buckets``. A bucket's gain is the floor of 1000 times the log ratio of its smoothed shares in
the target and in the corpus; a document's weight is the floored mean of its features' gains. Scores add Gumbel noise
that depends on seed and doc_id only, and the highest scores are drawn: sampling without replacement by weight.

Weights are exact, bit-sliced sums. A document's bucket counts are planes of ``buckets`` bits, plane i holding bit i of
every count; so are the gains, with planes of their own for positive and negative ones. Plane i of the counts AND plane j of
the gains has one bit for each bucket that adds 2**(i+j), so popcounts times powers of two give the sum, without rounding.

Corpus counts are a partial aggregation into at most ``buckets`` rows; only these, the target's and the gains are
gathered. Planes are made in Arrow batches. Ranks are counted by ranges of the score, so all rows may compete.

Cases: null, empty and wordless texts have no features and weight 0; they are never drawn, as they have fewer than
``least`` words; null doc_ids share their noise, and are drawn after others of their score, then by the hash of the text;
repeated rows each compete; an empty table or target is counted as no features; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import batches_of, cut, positions, words

BUCKETS, LEAST, PERCENT, SEED = 10_000, 20, 10, 2024
#: Documents of an Arrow batch, and feature entries whose planes are made at once.
BATCH, ENTRIES = 256, 1 << 20


def features(w: Column, grams: int, buckets: int) -> Column:
    """Buckets of all features of an array of words, repeats included."""
    def longer(k: int) -> Column:
        return F.slice(F.transform(w, lambda x, i: F.array_join(F.slice(w, i + 1, k), " ")), 1, F.greatest(F.size(w) - (k - 1), F.lit(0)))

    runs = [w] + [longer(k) for k in range(2, grams + 1)]
    return F.transform(F.concat(*runs) if grams > 1 else w, lambda x: (F.crc32(x) % buckets).cast("int"))


def bucket_counts(texts: DataFrame, grams: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts; buckets without features are left out."""
    return texts.select(F.explode(features(words(F.col("text")), grams, buckets)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(documents: DataFrame, target: DataFrame, grams: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, as whole numbers."""
    of = bucket_counts(target, grams, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    both = cut(bucket_counts(documents, grams, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(of).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    total = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    every = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left")
    double = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    ratio = (double("t") + 1) * F.lit(float((total["s"] or 0) + buckets)) / ((double("s") + 1) * F.lit(float((total["t"] or 0) + buckets)))
    out = np.zeros(buckets, np.int64)
    for r in every.select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain")).collect():  # a row a bucket
        out[r["bucket"]] = r["gain"]
    return out


def planes(values: np.ndarray) -> list[np.ndarray]:
    """Bit planes of the last axis of an array of whole numbers from 0, packed into 64-bit words."""
    out = []
    for i in range(int(values.max(initial=0)).bit_length()):
        packed = np.packbits((values >> i & 1).astype(np.bool_), axis=-1)
        wide = np.zeros((*packed.shape[:-1], -(-packed.shape[-1] // 8) * 8), np.uint8)
        wide[..., : packed.shape[-1]] = packed
        out.append(wide.view(np.uint64))
    return out


def _sums(counts: list[np.ndarray], positive: list[np.ndarray], negative: list[np.ndarray], rows: int) -> np.ndarray:
    """Exact sums of counts times gains, by row, from their planes."""
    out = np.zeros(rows, np.int64)
    for i, held in enumerate(counts):
        some = held.any(axis=1)
        for sign, sliced in ((1, positive), (-1, negative)):
            for j, plane in enumerate(sliced):
                out[some] += sign * (np.bitwise_count(held[some] & plane).sum(axis=1, dtype=np.int64) << (i + j))
    return out


def _weights(gain: np.ndarray):
    positive, negative, buckets = planes(np.maximum(gain, 0)), planes(np.maximum(-gain, 0)), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("__f")
            ends = np.asarray(lists.offsets, np.int64)
            entries = np.asarray(lists.values)
            sizes, sums = np.diff(ends), np.zeros(len(lists), np.int64)
            # the planes of a few documents at a time: documents * buckets counts are held as whole numbers
            step = max(1, ENTRIES // buckets)
            for at in range(0, len(lists), step):
                some = sizes[at : at + step]
                flat = np.repeat(np.arange(len(some)) * buckets, some) + entries[ends[at] : ends[at + len(some)]]
                sums[at : at + step] = _sums(planes(np.bincount(flat, minlength=len(some) * buckets).reshape(len(some), buckets)), positive, negative, len(some))
            weight = np.where(sizes > 0, sums // np.maximum(sizes, 1), 0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "__row", "n_words")], pa.array(sizes, pa.int64()), pa.array(weight, pa.int64())], ["doc_id", "__row", "n_words", "n_features", "weight"])

    return run


def weigh(documents: DataFrame, gain: np.ndarray, grams: int = 1) -> DataFrame:
    """(doc_id, __row, n_words, n_features, weight) of every document; __row is the hash of its text."""
    rows = documents.select("doc_id", F.xxhash64("text").alias("__row"), words(F.col("text")).alias("__w"))
    rows = rows.select("doc_id", "__row", features(F.col("__w"), grams, len(gain)).alias("__f"), F.size("__w").cast("long").alias("n_words"))
    return rows.mapInArrow(_weights(gain), "doc_id long, __row long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, grams: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank counts the drawn ones from 1, others have null.

    Of the documents with at least ``least`` words, ``percent`` percent (rounded down) are drawn.
    """
    with batches_of(documents.sparkSession, BATCH):
        rows = cut(weigh(documents, gains(documents, target, grams, buckets), grams).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    rows = rows.select("*", F.when(F.col("n_words") >= least, F.lit("drawn")).otherwise(F.lit("left")).alias("__pool"))
    ranked = positions(rows, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("__row")], "__pool")
    drawn = (F.col("__pool") == "drawn") & (F.col("pos") < F.floor(F.col("n") * percent / 100))
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("pos") + 1).alias("rank"))
