"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType
from pyspark.sql.window import Window

from tideline.sources.scan import remove, shared_folder

#: Everything that isn't a-z, 0-9 or beyond ASCII separates words (after lower-casing A-Z).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes that a broadcast side may have at most (``size_of``); larger sides are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Rows of one key from which ``attach`` joins them by broadcast.
HOT_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: its lineage ends there.

    ``group_bytes``: row groups of about as many bytes, which tasks that write or read rows hold, instead of Parquet's 128 MB.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    (df.write if group_bytes is None else df.write.option("parquet.block.size", str(group_bytes))).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


@contextmanager
def batches_of(spark: SparkSession, rows: int, read: bool = False) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows in the jobs that run inside: for rows that may be long.

    ``read``: batches of the Parquet reader too, which knows no bytes and takes 4,096 rows of any length otherwise.
    """
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", *["spark.sql.parquet.columnarReaderBatchSize"] * read]
    held = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        for name in names:
            spark.conf.set(name, held[name])


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once everything that was derived from them is itself written."""
    for df in tables:
        remove(df.sparkSession, df.cut_at)


def size_of(df: DataFrame) -> int:
    """Bytes of all values of ``df``: texts as they are, 16 for any other value."""
    total = F.lit(0)
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, StringType | BinaryType):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif isinstance(field.dataType, ArrayType):
            total = total + F.greatest(F.size(c), F.lit(1)) * 16 + (F.coalesce(F.octet_length(F.array_join(c, "")), F.lit(0)) if isinstance(field.dataType.elementType, StringType) else 0)
        else:
            total = total + 16
    return df.agg(F.sum(total.cast("long")).alias("b")).first()["b"] or 0


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` (a table that ``cut`` wrote) with a broadcast hint if it has few enough bytes, else as it is."""
    return F.broadcast(df) if size_of(df) <= (BROADCAST_BYTES if limit is None else limit) else df


def attach(rows: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``side``, which has one row for each ``key``; keys with many rows don't meet in one task.

    Keys with over ``HOT_ROWS`` rows (counted by a partial aggregation, so there are few of them) get their part of
    ``side`` by broadcast, if that part is small enough; all others by an ordinary join. ``rows`` is read several times
    and should be a written table.
    """
    if rows.count() <= HOT_ROWS:
        return rows.join(side, key, how)
    hot = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT_ROWS).select(F.col(key).alias("__hot")))
    if hot.isEmpty():
        return rows.join(side, key, how)
    chosen = cut(side.join(small(hot), F.col(key) == F.col("__hot"), "left_semi"))
    marked = rows.join(small(hot), F.col(key) == F.col("__hot"), "left")
    often, seldom = marked.where("__hot is not null").drop("__hot"), marked.where("__hot is null").drop("__hot")
    return often.join(small(chosen), key, how).unionByName(seldom.join(side, key, how))


def positions(rows: DataFrame, order: list[Column], group: str) -> DataFrame:
    """``rows`` (a written table) with pos, a row's place from 0 in its ``group`` by ``order``, and n, the group's rows.

    Rows are sorted by ranges of (group, order), so no group meets in one task; a range's rows of a group are counted on
    from those of the ranges before it. ``order`` must tell all rows apart that differ, and ``group`` holds no nulls.
    """
    by = [F.col(group), *order]
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # numbers are written down with the rows, so a lost executor can't deal them anew
    dealt = cut(rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    held = dealt.groupBy(F.col(group).alias("__g"), F.shiftright("__at", 33).alias("__part")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy("__g")  # as many rows as ranges, at most
    before = F.sum("__n").over(whole.orderBy("__part")) - F.col("__n") - F.col("__first")
    starts = small(cut(held.select("__g", "__part", before.alias("__shift"), F.sum("__n").over(whole).alias("n"))))
    told = dealt.join(starts, (F.col(group) == F.col("__g")) & (F.shiftright("__at", 33) == F.col("__part")))
    return told.withColumn("pos", F.col("__at") + F.col("__shift")).drop("__at", "__g", "__part", "__shift")


def boxed(documents: DataFrame, *without: str) -> DataFrame:
    """One column, __doc, that holds all columns of ``documents``: beside it no name can clash with theirs."""
    return documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns if c not in without]).alias("__doc"))


def ascii_lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of ``text`` with A-Z lower-cased (null: no words)."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def shingle_hashes(w: Column, k: int = 5) -> Column:
    """Hashes of all ``k`` consecutive words; fewer words than ``k``: none."""
    hashed = F.transform(w, lambda x, i: F.when(i <= F.size(w) - k, F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)])))
    return F.slice(hashed, 1, F.greatest(F.size(w) - (k - 1), F.lit(0)))
