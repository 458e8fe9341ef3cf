import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def rows(frame_rows, columns):
    import math

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 5) + 0.0
        return v if v is None or isinstance(v, (bool, int)) else str(v)

    return sorted((tuple(plain(r[c]) for c in columns) for r in frame_rows), key=repr)


@pytest.fixture(scope="session")
def same(spark, data, duck):
    """Compares a registered query with its SQL."""

    def check(f, sql):
        df = f(spark, data)
        columns = sorted(df.columns)
        r = duck.execute(sql)
        names = [x[0] for x in r.description]
        assert sorted(names) == columns
        want = rows([dict(zip(names, x, strict=True)) for x in r.fetchall()], columns)
        assert rows(df.collect(), columns) == want

    return check
