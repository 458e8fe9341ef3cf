"""Scans, snapshots and sinks."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinities of float columns become null."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.select(*[F.when(~bad(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields])


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet by its own or a stated schema, numbers cleaned."""
    return clean_numbers((spark.read.schema(schema) if schema else spark.read).parquet(path))


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Snappy Parquet, partitioned by the analysis type or other columns."""
    w = df.write.mode("overwrite").option("compression", "snappy")
    (w.partitionBy(*by) if by else w).parquet(path)


def read_sidecars(parquet: DataFrame, csv: DataFrame, session: str = "session") -> DataFrame:
    """S3: each session's Parquet rows, its CSV rows only where it has no Parquet."""
    return parquet.unionByName(csv.join(parquet.select(session).distinct(), session, "left_anti"), allowMissingColumns=True)


def first_sessions(df: DataFrame, session: str, n: int | None = None, only: str | None = None) -> DataFrame:
    """Rows of a run, optionally those that pass a condition and of the first n sessions by name."""
    df = df.where(only) if only else df
    if n is None:
        return df
    return df.join(df.select(session).distinct().orderBy(session).limit(n), session, "left_semi")


def file_rows(df: DataFrame) -> DataFrame:
    """Rows with the name, path and time of their file."""
    return df.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("file_time"))


def latest_snapshots(files: DataFrame, name: str = "file_name", path: str = "file_path", time: str = "file_time", classes: list[str] | None = None) -> DataFrame:
    """One file per type of <dataset>_<type>_<yyyymmdd_hhmmss>.<ext>: best path class, then the newest."""
    pattern = r"^([^_]+)_(.+)_(\d{8}_\d{6})\.[A-Za-z]+$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    level = F.lit(len(classes or []))
    for i, c in reversed(list(enumerate(classes or []))):
        level = F.when(F.col(path).contains(c), i).otherwise(level)
    f = files.withColumns({"dataset": part(1), "type": part(2), "stamp": part(3), "path_class": level}).where("type <> ''")
    n = F.row_number().over(Window.partitionBy("type").orderBy("path_class", F.col(time).desc(), F.col("stamp").desc(), name))
    return f.withColumn("__n", n).where("__n = 1").drop("__n")


def latest_non_empty(files: DataFrame, type_: str, rows: str, stamp: str = "stamp") -> DataFrame:
    """The newest file of a type that has rows."""
    return files.where((F.col("type") == type_) & (F.col(rows) > 0)).orderBy(F.col(stamp).desc(), "file_name").limit(1)


def keys_from_name(df: DataFrame, name: str, tasks: dict[str, str]) -> DataFrame:
    """Subject and task of sub-<id>_..._task-<task>_...; the task's label, or itself."""
    raw = F.nullif(F.regexp_extract(name, r"task-([A-Za-z0-9]+)", 1), F.lit(""))
    m = F.create_map(*[F.lit(x) for kv in tasks.items() for x in kv])
    return df.withColumn("subject", F.nullif(F.regexp_extract(name, r"(sub-[A-Za-z0-9]+)", 1), F.lit(""))).withColumn("raw_task", raw).withColumn("task", F.coalesce(F.element_at(m, raw), raw))


def read_events(spark: SparkSession, path: str, schema: str, kind: str = "trial_type", prefix: str = "Sync") -> DataFrame:
    """Event TSVs with keys from their file names, trial types with the prefix."""
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).option("nullValue", "n/a").csv(path)
    return keys_from_name(rows.select("*", F.col("_metadata.file_name").alias("file_name")), "file_name", {}).where(F.col(kind).startswith(prefix))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per (multi-line) JSON document, with a stated schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def explode_columns(df: DataFrame, keys: list[str], arrays: list[str], scalars: list[str] = ()) -> DataFrame:
    """Parallel arrays to one row per index (column i); arrays of different lengths give no rows."""
    same = reduce(lambda a, b: a & b, [F.size(a) == F.size(arrays[0]) for a in arrays])
    z = df.where(same).select(*keys, *scalars, F.posexplode(F.arrays_zip(*arrays)).alias("i", "__z"))
    return z.select(*keys, *scalars, "i", *[F.col(f"__z.{a}").alias(a) for a in arrays])


def source_catalog(frames: list[DataFrame], column: str) -> DataFrame:
    """Distinct non-null source paths of all tables."""
    return reduce(lambda a, b: a.unionByName(b), [f.select(column).distinct() for f in frames]).where(F.col(column).isNotNull()).distinct()


_KEPT: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM is gone: what it wrote stays
        pass


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see; where it is unset, a temporary one in local mode.

    It lies in a folder of this application, which is deleted when the driver's program ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    own = f"{base.rstrip('/')}/tideline/{spark.sparkContext.applicationId}"
    if own not in _KEPT:
        _KEPT.add(own)
        atexit.register(_at_exit, spark, own)
    return f"{own}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: several readers then share one computation."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
