"""Sharding: minimax contiguous partition of ordered atomic groups.

Documents with equal texts form a group that is never split; groups are ordered by their smallest doc_id. The
smallest feasible capacity (the largest shard's bytes) is found by binary search; a capacity is checked greedily:
each shard takes groups while they fit. Cuts are then placed under that capacity as near to equal shares of what
remains as they can be.

Only a bounded summary reaches the driver. Group ends (running sums of bytes) are counted by buckets of positions;
the last end of each bucket is a known cut. Greedy over known cuts proves a capacity feasible, greedy that may
cut anywhere in a bucket with further ends proves one infeasible; only buckets that can still decide between the
two are split in 64 and read again, until one capacity is left. Running sums are two-level: ordered ranges, then
the sums of the ranges, so neither a shard nor a group of copies is gathered in a task.

Cases: null counts as an empty text; a document costs its UTF-8 bytes plus ``overhead``; ties in doc_id go by the
text's hash; repeated rows take a slot each; a null id comes first; with fewer groups than shards some shards stay
empty; an empty table gives no rows; other columns are ignored (or kept, see ``shard_documents``).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import HOT_ROWS, attach, boxed, cut, small

BUCKETS, SPLIT = 12, 6  # powers of two


def ordered_rows(documents: DataFrame, overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, key, at, slot): bytes and rows that come before each row in the order of groups."""
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = cut(documents.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key")))
    joined = attach(rows, rows.groupBy("key").agg(F.min("doc_id").alias("first")), "key")  # a text may be a third of all rows
    order = [F.col("first").asc_nulls_first(), F.col("key"), F.col("doc_id").asc_nulls_first()]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the range of a row is written down, so a lost executor can't deal it anew
    ranged = cut(joined.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("held").over(over), F.lit(0)).alias("b"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("i"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ran = ranged.withColumn("s", F.sum("size").over(inside) - F.col("size")).withColumn("r", F.row_number().over(inside) - 1)
    return ran.join(F.broadcast(before), F.col("part") == F.col("p")).select("doc_id", "size", "text_crc32", "key", (F.col("s") + F.col("b")).alias("at"), (F.col("r") + F.col("i")).cast("long").alias("slot"))


class _Cuts:
    """Known group ends, whether further ends stand between an end and the one before it, and in which bucket."""

    def __init__(self, rows):
        self.of = {end: (shift, bucket, n > 1) for shift, bucket, end, n in rows}
        self.ends = sorted(self.of)

    def below(self, x: int) -> int:
        i = bisect_right(self.ends, x)
        return self.ends[i - 1] if i else 0

    def hopeful(self, x: int) -> int:
        i = bisect_left(self.ends, x)
        if i == len(self.ends):
            return self.ends[-1]
        return x if self.ends[i] == x or self.of[self.ends[i]][2] else (self.ends[i - 1] if i else 0)

    def path(self, capacity: int, shards: int, step) -> list[int]:
        out = [0]
        for _ in range(shards):
            out.append(step(out[-1] + capacity))
        return out

    def undecided(self, low: list[int], high: list[int]) -> set[tuple[int, int]]:
        """Buckets with further ends that a greedy cut between the two paths may fall in."""
        out = set()
        for a, b in zip(low, high, strict=True):
            for end in self.ends[bisect_left(self.ends, a) : bisect_left(self.ends, b) + 1]:
                if self.of[end][2]:
                    out.add(self.of[end][:2])
        return out


def _search(low: int, high: int, good) -> int:
    """The smallest value in (low, high] that is good, if high is."""
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if good(middle) else (middle, high)
    return high


def minimax_cuts(ends: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(smallest capacity, ``shards`` + 1 positions to cut at) for a table of group ends (column ``end``, ``bytes``)."""
    head = ends.agg(F.max("end").alias("total"), F.max("bytes").alias("most")).first()
    total = head["total"] or 0
    if not total:
        return 0, [0] * (shards + 1)
    shift = max(0, total.bit_length() - BUCKETS)

    def read(frame: DataFrame, by: int):
        got = frame.groupBy(F.shiftright(F.col("end") - 1, by).alias("b")).agg(F.max("end").alias("e"), F.count(F.lit(1)).alias("n"))
        return [(by, r["b"], r["e"], r["n"]) for r in got.collect()]

    cuts = _Cuts(read(ends, shift))
    floor = max(head["most"], -(-total // shards))
    low, high = floor - 1, total
    while True:
        reach = lambda step: lambda c: cuts.path(c, shards, step)[-1] >= total
        high = _search(low, high, reach(cuts.below))
        low = max(low, _search(low, high, reach(cuts.hopeful)) - 1)
        if high - low <= 1:
            break
        todo = cuts.undecided(cuts.path(low + 1, shards, cuts.below), cuts.path(high, shards, cuts.hopeful))
        by = min(s for s, _ in todo)
        for s in {s for s, _ in todo}:
            wanted = [b for x, b in todo if x == s]
            found = read(ends.where(F.shiftright(F.col("end") - 1, s).isin(wanted)), max(0, s - SPLIT))
            for end in [e for e, x in cuts.of.items() if x[0] == s and x[1] in set(wanted)]:
                del cuts.of[end]
            cuts.of.update({e: (x, b, n > 1) for x, b, e, n in found})
        cuts.ends = sorted(cuts.of)
        if by == 0 and not todo:
            break
    return high, _even(cuts, high, total, shards)


def _even(cuts: _Cuts, capacity: int, total: int, shards: int) -> list[int]:
    """Cuts at known ends under ``capacity``, as near to equal shares as the rest allows."""
    ends = [0, *cuts.ends]
    latest = [total]  # from the back: the first position from which the remaining shards still reach the end
    for _ in range(shards):
        latest.append(ends[bisect_left(ends, max(0, latest[-1] - capacity))])
    latest.reverse()
    out = [0]
    for k in range(1, shards):
        at, ideal = out[-1], (total - out[-1]) / (shards - k + 1)
        i = bisect_right(ends, at + ideal)
        near = [e for e in ends[max(0, i - 1) : i + 1] if at < e <= at + capacity]
        best = min(near, key=lambda e: abs(e - at - ideal)) if near else at
        out.append(max(best, latest[k]))
    return [*out, total]


def assign(documents: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, key, shard, slot) of every row; slots count from 0 in each shard."""
    rows = cut(ordered_rows(documents, overhead))
    ends = cut(rows.groupBy("key").agg(F.max(F.col("at") + F.col("size")).alias("end"), F.sum("size").alias("bytes")))
    _, cuts = minimax_cuts(ends, shards)
    borders = F.array(*[F.lit(c).cast("long") for c in cuts[1:-1]])
    # a row lies after as many borders as its shard's number; empty shards share a border
    placed = rows.withColumn("shard", F.size(F.filter(borders, lambda b: b <= F.col("at"))).cast("int")) if shards > 1 else rows.withColumn("shard", F.lit(0))
    starts = placed.groupBy(F.col("shard").alias("s")).agg(F.min("slot").alias("start"))  # a row per shard
    return placed.join(F.broadcast(starts), F.col("shard") == F.col("s")).select("doc_id", "size", "text_crc32", "key", "shard", (F.col("slot") - F.col("start")).alias("slot"))


def shard_documents(documents: DataFrame, shards: int = 40) -> DataFrame:
    """All columns of ``documents`` and the shard of each row (it replaces a column of that name).

    Rows get their shard by their text's hash; a text that many rows share is joined by broadcast.
    """
    placed = cut(assign(documents, shards).select(F.col("key").alias("__key"), "shard"))
    of = cut(placed.groupBy("__key").agg(F.min("shard").alias("__shard"), F.count(F.lit(1)).alias("__n")))
    keyed = boxed(documents, "shard").withColumn("__at", F.unhex(F.md5(F.coalesce("__doc.text", F.lit("")))))
    often = small(cut(of.where(F.col("__n") > HOT_ROWS).select(F.col("__key").alias("__hot"), F.col("__shard").alias("__its"))))
    marked = keyed.join(often, F.col("__at") == F.col("__hot"), "left")
    hot = marked.where("__hot is not null").select("__doc", F.col("__its").alias("shard"))
    rest = small(of.where(F.col("__n") <= HOT_ROWS))
    cold = marked.where("__hot is null").join(rest, F.col("__at") == F.col("__key")).select("__doc", F.col("__shard").alias("shard"))
    return hot.union(cold).select("__doc.*", "shard")
