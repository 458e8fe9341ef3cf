"""Running aggregates within keys of any size: by ranges of the order, with what earlier ranges hold carried on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.sources.scan import written

FUNCTIONS = {"sum": F.sum, "max": F.max, "min": F.min}


def _both(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    if kind == "max":
        return F.when(a.isNull() | (b > a), b).otherwise(a)
    return F.when(a.isNull() | (b < a), b).otherwise(a)


def running(df: DataFrame, by: list[str], order: list[str], before: dict[str, tuple[str, Column]], after: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Adds aggregates over the rows of a key before (``before``) and after (``after``) each row, the row itself left out.

    Values are name -> (sum, max or min, column). Rows are dealt by ranges of key and order and written down with their
    range; a range is aggregated by itself, and one row for each range and key carries its aggregates to the others.
    Null keys are a key; rows equal in ``order`` stand in any order.
    """
    after = after or {}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = {name: (kind, c, ahead) for ahead, side in ((False, before), (True, after)) for name, (kind, c) in side.items()}
    rows = df.select("*", *[c.alias(f"__v_{name}") for name, (_, c, _) in values.items()])
    ranged = written(rows.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()))
    held = ranged.groupBy(*by, "__part").agg(*[FUNCTIONS[kind](f"__v_{name}").alias(f"__h_{name}") for name, (kind, _, _) in values.items()])
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    across = Window.partitionBy(*by).orderBy("__part")  # as many rows as ranges, at most
    carried = held.select(
        *[F.col(c).alias(f"__k_{c}") for c in by], F.col("__part").alias("__k_part"),
        *[FUNCTIONS[kind](f"__h_{name}").over(across.rowsBetween(1, last) if ahead else across.rowsBetween(first, -1)).alias(f"__c_{name}") for name, (kind, _, ahead) in values.items()],
    )
    inside = Window.partitionBy(*by, "__part").orderBy(*order)
    own = ranged.select("*", *[FUNCTIONS[kind](f"__v_{name}").over(inside.rowsBetween(1, last) if ahead else inside.rowsBetween(first, -1)).alias(f"__i_{name}") for name, (kind, _, ahead) in values.items()])
    on = [F.col("__part") == F.col("__k_part"), *[F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by]]
    return own.join(carried, on).select(*df.columns, *[_both(kind, F.col(f"__c_{name}"), F.col(f"__i_{name}")).alias(name) for name, (kind, _, _) in values.items()])
