"""The test tables in the shapes that the operators take, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark, d: str) -> DataFrame:
    """(subject, condition, value, event_id, k, time, t_idx): value is null for each 17th event."""
    e = table(spark, d, "events")
    seconds = F.expr("unix_date(cast(ts as date)) * 86400D + hour(ts) * 3600 + minute(ts) * 60 + cast(extract(second from ts) as double)")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("subject"), F.col("event_type").alias("condition"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"), "event_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"), seconds.alias("time"),
        (F.row_number().over(w) - 1).cast("long").alias("t_idx"),
    )


EVENTS = """ev AS (SELECT user_id AS subject, event_type AS condition, CASE WHEN event_id % 17 <> 0 THEN value END AS value, event_id,
 CAST(json_extract(props, '$.k') AS INTEGER) AS k, epoch_us(ts) / 1e6 AS time, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t_idx FROM events)"""


def trajectory(spark, d: str, axes: int = 9) -> DataFrame:
    """(session, t_idx, x0 ... , m, d, e, vec_id): embeddings as trajectories by label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    x = [F.col("embedding")[i].cast("double") for i in range(axes)]
    return table(spark, d, "embeddings").select(F.col("label").alias("session"), (F.row_number().over(w) - 1).cast("long").alias("t_idx"), "vec_id", x[0].alias("m"), x[1].alias("d"), x[2].alias("e"), *[c.alias(f"x{i}") for i, c in enumerate(x)])


TRAJECTORY = (
    "tr AS (SELECT label AS session, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t_idx, vec_id, embedding[1]::DOUBLE AS m, embedding[2]::DOUBLE AS d, embedding[3]::DOUBLE AS e, "
    + ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(9))
    + " FROM embeddings)"
)


def signal(spark, d: str) -> DataFrame:
    """(session, roi, network, t_idx, value): embeddings as multi-channel signals."""
    w = Window.partitionBy("label").orderBy("vec_id")
    t = table(spark, d, "embeddings").select(F.col("label").alias("session"), (F.row_number().over(w) - 1).cast("long").alias("t_idx"), "embedding")
    return t.select("session", "t_idx", F.posexplode("embedding").alias("roi", "v")).select("session", "roi", (F.col("roi") % 7).alias("network"), "t_idx", F.col("v").cast("double").alias("value"))


SIGNAL = """tx AS (SELECT label AS session, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t_idx, embedding FROM embeddings),
sg AS (SELECT session, (i - 1)::INTEGER AS roi, ((i - 1) % 7)::INTEGER AS network, t_idx, embedding[i]::DOUBLE AS value FROM tx, range(1, 65) r(i))"""


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places (and -0 made 0), as the oracles do."""
    return df.select(*[(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
