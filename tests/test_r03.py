"""Results that hang on the order of sums or on halves, and large groups of replicates: against SQL, packed groups, numpy."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tideline.functions import resample, scalars
from tideline.operators import contrasts, metrics, resampling, stats
from tideline.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def mixed(tmp_path_factory):
    """Events of two decimals, in an order of rows that isn't that of Spark's tasks: row groups are few rows, ts is alike."""
    return _events(tmp_path_factory.mktemp("mixed"), lambda r, n: np.round(r.gamma(2, 15, n), 2))


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """The same of tenths, so that many means are equal but for the order of their sums."""
    return _events(tmp_path_factory.mktemp("tied"), lambda r, n: r.integers(1, 12, n) / 10)


def _events(at, values):
    r, n = np.random.default_rng(21), 24_000
    kinds = np.array(["view", "click", "error", "purchase"])
    table = pa.table({"event_id": np.arange(n), "ts": pa.array(np.full(n, 1_700_000_000_000_000), pa.timestamp("us")), "user_id": r.integers(0, 900, n), "event_type": kinds[r.integers(0, 4, n)], "value": values(r, n), "props": [f'{{"k": {k}}}' for k in r.integers(0, 100, n)]})
    pq.write_table(table, at / "events.parquet", row_group_size=1000)
    return str(at)


def equals_sql(spark, folder, name):
    """Exactly, as text: the oracle reads rows one after the other."""
    import duckdb

    c = duckdb.connect()
    c.execute("set threads = 1")
    c.execute(f"create view events as select * from '{folder}/events.parquet'")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")  # a key's rows lie in several tasks
    try:
        df = QUERIES[name](spark, folder)
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    out = c.execute(SQL[name])
    names = [x[0] for x in out.description]
    text = lambda told: sorted(repr(tuple(q[x] for x in names)) for q in told)
    assert sorted(names) == sorted(df.columns) and text(got) == text(dict(zip(names, x, strict=True)) for x in out.fetchall())


def test_f1_effect_matrix(spark, mixed):
    equals_sql(spark, mixed, "d9_effect_matrix")
    values = [11.824999999999999, -11.824999999999999, 0.125, -0.001, 1e300, None, 1234.567]
    got = [q.v for q in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(scalars.rounded(F.col("v"), 2).alias("v")).collect()]
    assert repr(got) == repr([11.83, -11.83, 0.13, -0.0, 1e300, None, 1234.57])
    cells = metrics.effect_matrix(spark.createDataFrame([("a", "x", 1234.5, 0.2, None), ("a", "y", None, 0.2, None)], "s string, c string, effect double, p double, q double"), "s", "c", ["x", "y"]).collect()
    assert [tuple(q) for q in cells] == [("a", "1234.50", None)]


def test_f2_zero_differences(spark, tied):
    """A difference of equal means counts where the SQL's sums leave a last bit, and only there."""
    equals_sql(spark, tied, "t11_wilcoxon")
    equals_sql(spark, tied, "t18_pairwise")


def test_f3_ties_of_means(spark, tied):
    equals_sql(spark, tied, "t16_correlation_grid")


@pytest.fixture(scope="module")
def paired(spark):
    r = np.random.default_rng(22)
    data = {"a": np.round(r.normal(0.1, 1, 701), 1), None: r.normal(size=500), "small": r.normal(size=9)}
    rows = [(g, i, float(v), float(w)) for g, vs in data.items() for i, (v, w) in enumerate(zip(vs, np.round(vs + r.normal(size=len(vs))), strict=True))] + [("a", 9_000, None, 1.0)]
    return data, spark.createDataFrame(rows, "g string, i long, v double, w double").repartition(5).cache()


def close(got, want):
    for a, b in zip(sorted(got, key=lambda q: repr(q.g)), sorted(want, key=lambda q: repr(q.g)), strict=True):
        assert all(x == y if x is None or isinstance(x, (str, bool)) else x == pytest.approx(y, abs=1e-9) for x, y in zip(a, b, strict=True)), (a, b)


def ranks(v):
    return (v[:, None] > v).sum(1) + (v[:, None] == v).sum(1) / 2


def exploded(*_, **__):
    raise AssertionError("rows times replicates")


def test_f6_signs_outside_the_band_go_in_whole_batches(spark, paired, monkeypatch):
    want = stats.median_sign_p(paired[1], ["g"], "v", "i", 130).collect()
    batches, kept = [], resampling.written

    def told(df):
        if "signs" in df.columns:
            batches.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return kept(df)

    monkeypatch.setattr(resampling, "written", told)
    monkeypatch.setattr(resampling, "PACK", 64)
    close(stats.median_sign_p(paired[1], ["g"], "v", "i", 130).collect(), want)
    assert batches and min(batches) >= 1000


@pytest.mark.parametrize("tile", [100, 10_000])
def test_f9_bootstrap_moments_of_tiles(spark, paired, monkeypatch, tile):
    data, df = paired
    calls = [lambda: stats.bootstrap_ci(df, ["g"], "v", "i", 130), lambda: stats.bootstrap_dz(df, ["g"], "v", "i", 130)]
    want = [f().collect() for f in calls]
    for name, value in (("PACK", 64), ("TILE", tile), ("CHUNK", 37)):
        monkeypatch.setattr(resampling, name, value)
    monkeypatch.setattr(stats, "resampled", exploded)
    for f, w in zip(calls, want, strict=True):
        close(f().collect(), w)
    keys = np.array([q.key for q in spark.range(701).select("id", resample.item_key(0, "id", "boot").alias("key")).orderBy("id").collect()])
    got = {(q.g, q.rep): q for q in resampling.drawn_moments(df.where("v is not null"), ["g"], "i", 130).collect()}
    for g, v in data.items():
        x = v[resample.draws(keys[: len(v)], np.arange(130)).astype(np.int64) * len(v) >> 32]
        assert [got[g, k].mean for k in range(130)] == pytest.approx(list(x.mean(1)), abs=1e-12) and [got[g, k]["var"] for k in range(130)] == pytest.approx(list(x.var(1, ddof=1)), abs=1e-12)


def test_f7_rank_correlations_of_gathered_groups(spark, paired, monkeypatch):
    data, df = paired
    call = lambda: stats.bootstrap_spearman(df, ["g"], "v", "w", "i", 130).collect()
    want = call()
    rows = {g: np.array([(q.v, q.w) for q in df.where(F.col("g").eqNullSafe(g) & F.col("v").isNotNull()).orderBy("i").collect()]) for g in data}
    keys = np.array([q.key for q in spark.range(701).select("id", resample.item_key(0, "id", "boot").alias("key")).orderBy("id").collect()])
    for g, x in rows.items():
        s = [np.corrcoef(*[ranks(c) for c in x[at].T])[0, 1] for at in resample.draws(keys[: len(x)], np.arange(130)).astype(np.int64) * len(x) >> 32]
        q = next(q for q in want if q.g == g)
        assert (q.ci_low, q.ci_high, q.se) == pytest.approx((*np.quantile(s, [0.025, 0.975]), np.std(s, ddof=1)), abs=1e-9)
    monkeypatch.setattr(resampling, "PACK", 64)
    monkeypatch.setattr(stats, "HELD", 600)
    close(call(), want)  # one group gathered, one exploded, one packed
    monkeypatch.setattr(stats, "HELD", 10_000)
    monkeypatch.setattr(stats, "resampled", exploded)
    close(call(), want)


def test_f8_driver_of_large_groups(spark, monkeypatch):
    r = np.random.default_rng(23)
    rows = [(s, c, m, i, float(v), True) for i, (s, c, m, v) in enumerate((s, c, m, v) for s in range(300) for c in ("x", "y", "z") for m in ("p", "q") for v in r.normal(0.1 * (c == "y"), 1, 2))]
    long = spark.createDataFrame(rows, "s long, condition string, g string, id long, value double, ok boolean")
    pairs = spark.createDataFrame([("xy", "x", "y"), ("xz", "x", "z")], "contrast_name string, left string, right string")
    call = lambda: sorted(contrasts.drive(long, pairs, ["g"], "s", 150, 130, "id").collect(), key=repr)
    want = call()
    monkeypatch.setattr(resampling, "PACK", 64)
    monkeypatch.setattr(stats, "resampled", exploded)
    close(call(), want)
