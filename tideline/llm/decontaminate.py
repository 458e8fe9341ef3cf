"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Sets are the distinct five-word shingles of a text (words: see ``common.words``). A document leaks an item
when it holds at least ``threshold`` of the item's shingles, wherever they stand. An item of one to four words is one
shingle, its whole sequence, and leaks where that sequence stands.

Index: each item is put into a size partition (powers of two of its shingle count) and keeps its bottom-k
MinHash sketch, the k smallest shingle hashes. In a partition whose largest item has n shingles,
k = n - ceil(threshold * n) + 1: a document with enough of an item's shingles can lack fewer than k of them,
so it holds at least one of the sketch. No leak is lost, whatever the lengths. A document with fewer shingles
than the smallest qualifying overlap of a partition skips that partition.

Search: the documents' shingle hashes meet the sketches (a few per item, broadcast if few enough, else a
salted shuffled join). Verify: only documents with a candidate are read again, and shingles are compared as text.

Cases: null, empty and wordless texts and items neither leak nor match; repeated rows count
once; rows that share an id are judged each by its text and give the id's largest containment; null ids are
kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import common
from tideline.llm.common import boxed, cut, shingle_hashes, size_of, small, words

K, THRESHOLD = 5, 0.8
#: Parts that a shuffled join deals each key to.
SALTS = 32


def _shingles(w, sizes=(K,)):
    """Distinct runs of words of each of the given lengths, as text."""

    def run(k):
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", F.slice(w, i + 1, k)))

    runs = [run(k) for k in sizes]
    return F.array_distinct(F.concat(*runs) if len(runs) > 1 else runs[0])


def _by_length(w, of):
    """``of(k)`` for a text of k words, k at most K."""
    out = of(K)
    for k in range(1, K):
        out = F.when(F.size(w) == k, of(k)).otherwise(out)
    return out


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item, item_id, k, n, needed, part, least, shingles, sketch) of each distinct item text that has words; k: words in a shingle."""
    w = F.col("w")
    rows = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    hashes = _by_length(w, lambda k: F.array_sort(F.array_distinct(shingle_hashes(w, k))))
    rows = rows.select("item_id", F.least(F.size("w"), F.lit(K)).alias("k"), _by_length(w, lambda k: _shingles(w, (k,))).alias("shingles"), hashes.alias("hashes"))
    rows = rows.withColumn("n", F.size("shingles")).withColumn("part", F.floor(F.log2(F.col("n"))).cast("int"))
    rows = rows.withColumn("needed", F.ceil(F.col("n") * F.lit(threshold) - 1e-9))
    low, high = F.pow(F.lit(2), F.col("part")), F.pow(F.lit(2), F.col("part") + 1) - 1
    k = (high - F.ceil(high * F.lit(threshold) - 1e-9) + 1).cast("int")
    rows = rows.withColumn("least", F.ceil(low * F.lit(threshold) - 1e-9)).withColumn("sketch", F.slice("hashes", F.lit(1), k))
    return rows.withColumn("item", F.xxhash64("item_id", F.concat_ws("|", "shingles"))).drop("hashes")


def _meet(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to a written table of items' parts: by broadcast if it is small, else by shuffle.

    What is shuffled is salted, so the rows of a very common key go to ``SALTS`` tasks; the items' side is repeated
    for each salt, as it is much the smaller one.
    """
    if size_of(side) <= common.BROADCAST_BYTES:
        return rows.join(F.broadcast(side), key)
    salted = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.hash("doc_id", "row"), F.lit(SALTS))).join(salted, [key, "__salt"]).drop("__salt")


def leaking_rows(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, row, item_id, shared, n) of each document's text (row: its hash) and item at or above ``threshold``."""
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("row"))
    index = cut(sketches(items, threshold))
    sizes = sorted(r["k"] for r in index.select("k").distinct().collect()) or [K]  # K lengths at most
    probes = cut(index.select(F.explode("sketch").alias("h"), "item", "k", "least").distinct())
    hashed = docs.select("doc_id", "row", words(F.col("text")).alias("w")).where(F.size("w") >= sizes[0])
    hs = [shingle_hashes(F.col("w"), k) for k in sizes]
    hashed = hashed.select("doc_id", "row", F.size("w").alias("n_words"), (F.concat(*hs) if len(hs) > 1 else hs[0]).alias("hs"))
    # explode_outer: for explode, the optimizer would copy the whole expression into a filter
    met = _meet(hashed.select("doc_id", "row", "n_words", F.explode_outer("hs").alias("h")), probes, "h")
    candidates = cut(met.where(F.col("n_words") - F.col("k") + 1 >= F.col("least")).select("doc_id", "row", "item").distinct())
    wanted = small(cut(candidates.select("doc_id").distinct()))
    again = docs.join(wanted.withColumnRenamed("doc_id", "wanted"), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    held = again.select("doc_id", "row", words(F.col("text")).alias("w")).dropDuplicates(["doc_id", "row"])
    held = held.select("doc_id", "row", F.explode_outer(_shingles(F.col("w"), sizes)).alias("shingle"))
    asked = cut(index.select("item", "item_id", "n", "needed", F.explode("shingles").alias("shingle")))
    pairs = _meet(held, asked, "shingle").groupBy("doc_id", "row", "item", "item_id", "n", "needed").agg(F.count(F.lit(1)).alias("shared"))
    c = candidates.select(F.col("doc_id").alias("c_doc"), F.col("row").alias("c_row"), F.col("item").alias("c_item"))
    found = pairs.join(c, (F.col("row") == F.col("c_row")) & (F.col("item") == F.col("c_item")) & F.col("doc_id").eqNullSafe(F.col("c_doc")), "left_semi")
    return found.where("shared >= needed").select("doc_id", "row", "item_id", "shared", "n")


def leaks(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, shared, n_item, containment) of every document and item at or above ``threshold``."""
    found = leaking_rows(documents, items, threshold)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("n")).alias("containment"), F.col("shared"), F.col("n").cast("long").alias("n_item"))).alias("b"))
    return best.select("doc_id", "item_id", "b.shared", "b.n_item", F.round("b.containment", 6).alias("containment"))


def clean(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` without those that leak an item, known by id and text; all columns stay."""
    bad = small(cut(leaking_rows(documents, items, threshold).select(F.col("doc_id").alias("__bad"), F.col("row").alias("__row")).distinct()))
    rows = boxed(documents).join(bad, F.col("__doc.doc_id").eqNullSafe(F.col("__bad")) & (F.xxhash64("__doc.text") == F.col("__row")), "left_anti")
    return rows.select("__doc.*")
