"""Operators that go by ranges, on keys with many rows: against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import resample
from tideline.operators import contrasts, joins, metrics, quantiles, ranges, reachability, resampling, sequences, stats, tiles


def test_quantiles_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "AT_ONCE", 50)
    r = np.random.default_rng(1)
    n = 3000
    groups = {"normal": r.normal(size=n), "wide": 10.0 ** r.uniform(-300, 300, n) * r.choice([-1, 1], n), "ties": np.round(r.normal(size=n), 1), "one": np.r_[np.zeros(n - 1), 1.0], "huge": np.r_[[-1.7e308] * 30, [1.7e308] * 31], "few": np.array([3.0, 1.0]), None: r.normal(size=70)}
    rows = [(k, float(v), float(-v)) for k, vs in groups.items() for v in vs] + [("null", None, None), ("few", None, None)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    got = {x.k: x for x in quantiles.quantiles(df, ["k"], {"v": F.col("v"), "w": F.col("w")}, {"q1": 0.01, "median": 0.5, "q99": 0.99}, "mad").collect()}
    assert set(got) == {*groups, "null"} and got["null"].v_median is None and got["null"].w_mad is None
    for k, vs in groups.items():
        x = got[k]
        mad = np.median(np.abs(vs - np.median(vs)))
        assert [x.v_q1, x.v_median, x.v_q99] == pytest.approx(np.quantile(vs, [0.01, 0.5, 0.99]), rel=1e-12)
        assert [x.w_q1, x.w_q99] == pytest.approx(np.quantile(-vs, [0.01, 0.99]), rel=1e-12) and x.w_median == pytest.approx(-x.v_median)
        assert x.v_mad == pytest.approx(mad, rel=1e-12) and x.w_mad == pytest.approx(mad, rel=1e-12)
    whole = quantiles.quantiles(df, [], {"v": F.col("v")}, {"median": 0.5}).collect()
    assert len(whole) == 1 and whole[0].v_median == np.median(np.concatenate(list(groups.values())))
    assert quantiles.quantiles(df.where("k = 'absent'"), ["k"], {"v": F.col("v")}, {"median": 0.5}, "mad").count() == 0


@pytest.fixture(scope="module")
def dense(spark):
    """20,000 points of one subject in one second, a few of another, some without time or subject."""
    r = np.random.default_rng(2)
    rows = [("hot", float(np.round(t, 3)), i) for i, t in enumerate(r.uniform(100, 101, 20_000))] + [("cold", float(t), 20_000 + t) for t in range(0, 50, 7)] + [(None, 100.5, 30_000), ("hot", None, 30_001)]
    return rows, spark.createDataFrame(rows, "s string, t double, id long")


def test_intervals_and_nearest_in_one_dense_second(spark, dense):
    rows, points = dense
    r = np.random.default_rng(3)
    starts = [("hot", float(np.round(t, 3)), i) for i, t in enumerate(r.uniform(98.5, 101.5, 400))] + [("cold", 6.9, 900), ("cold", 7.0, 901), ("cold", 6.0, 902), ("none", 3.0, 903), ("hot", None, 904)]
    windows = spark.createDataFrame(starts, "s string, start double, w long")
    length = 0.75
    inside = {w: [(t, i) for s2, t, i in rows if s2 == s and t is not None and start is not None and start <= t < start + length] for s, start, w in starts}
    n = joins.interval_count(windows, points, "s", "start", length, "t", "w").collect()
    assert {x.w: x.n_inside for x in n} == {w: len(v) for w, v in inside.items()} and len(n) == len(starts)
    # the last by an order that isn't that of time
    coded = points.withColumn("code", F.col("id") % 5).withColumn("o", F.col("id") * 7919 % 30_011)
    got = {x.w: x.stage for x in joins.stage_of_windows(windows, coded, "s", "start", length, "t", "w", "code", "o").collect()}
    assert got == {w: max(((i * 7919 % 30_011, i % 5) for _, i in v), default=(0, -1))[1] for w, v in inside.items()}
    near = {x.w: (x.near_t, x.near_id) for x in joins.asof_nearest(windows, points, "s", "start", "t", length, "w", ["id"]).collect()}
    for s, start, w in starts:
        best = min(((round(abs(t - start), 12), t, i) for s2, t, i in rows if s2 == s and t is not None and start is not None and abs(t - start) <= length), default=(0, None, None))
        assert near[w] == best[1:], (s, start, near[w], best)


def test_running_carries_over_ranges(spark):
    r = np.random.default_rng(4)
    rows = [(k, int(i), float(v)) for k, n in (("a", 900), (None, 50), ("b", 1)) for i, v in enumerate(r.normal(size=n))]
    got = ranges.running(spark.createDataFrame(rows, "k string, i long, v double").repartition(5), ["k"], ["i"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, {"l": ("min", F.col("v"))}).collect()
    of = {k: [v for k2, _, v in rows if k2 == k] for k in ("a", None, "b")}
    assert len(got) == len(rows)
    for x in got:
        v = of[x.k]
        assert x.s == pytest.approx(sum(v[: x.i]), abs=1e-9) and x.m == max(v[: x.i], default=None) and x.l == min(v[x.i + 1 :], default=None)


def brute_nearest(x, ids, k):
    """Sorted by rounded squared distance and index."""
    d = sum((x[:, a, None] - x[None, :, a]) ** 2 for a in range(x.shape[1]))
    out = {}
    for i in range(len(x)):
        near = np.argpartition(d[i], min(3 * k, len(x) - 1))[: 3 * k] if len(x) > 3 * k else np.arange(len(x))
        out[ids[i]] = [j for _, j in sorted((round(d[i][j], 9), ids[j]) for j in near)][:k]
    return out


@pytest.mark.parametrize("whole", [250, 5000])
def test_nearest_and_pair_sums_over_many_tiles(spark, monkeypatch, whole):
    """By tiles beside keys that are one row, and with all keys as one row each."""
    monkeypatch.setattr(tiles, "TILE", 128)
    monkeypatch.setattr(tiles, "WHOLE", whole)
    r = np.random.default_rng(5)
    sessions = {"walk": np.cumsum(r.normal(size=(4000, 3)), axis=0), "lumps": r.normal(size=(1500, 3)) * 0.01 + r.integers(0, 6, (1500, 3)) * 100, "few": r.normal(size=(3, 3)), None: r.normal(size=(200, 3)), "line": np.c_[np.arange(300.0), np.zeros(300), np.zeros(300)]}
    rows = [(s, int(i), *map(float, p)) for s, x in sessions.items() for i, p in enumerate(x)] + [("walk", 5000, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "s string, i long, x double, y double, z double")
    got = {}
    for q in tiles.nearest(df, ["s"], "i", ["x", "y", "z"], 5).collect():
        got.setdefault(q.s, {}).setdefault(q.i, {})[q["rank"]] = q.neighbour
    assert set(got) == set(sessions)
    for s, x in sessions.items():
        want = brute_nearest(x, np.arange(len(x)), 5)
        assert {i: [v[k] for k in sorted(v)] for i, v in got[s].items()} == want, s
    sums = {q.s: q for q in tiles.pair_sums(df, ["s"], "i", ["x", "y", "z"], 0.1).collect()}
    assert set(sums) == set(sessions)
    for s, x in sessions.items():
        d = np.sqrt(sum((x[:, a, None] - x[None, :, a]) ** 2 for a in range(3)))[np.triu_indices(len(x), 1)]
        q = sums[s]
        assert (q.pairs, q.max_dist) == (len(d), d.max()) and q.mean_dist == pytest.approx(d.mean(), rel=1e-9) and q.close == (d <= 0.1 * d.max()).sum()


def test_nearest_of_equal_points(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 64)
    monkeypatch.setattr(tiles, "WHOLE", 100)
    df = spark.createDataFrame([("a", i, 1.0 + (i >= 290), 2.0) for i in range(300)], "s string, i long, x double, y double")
    got = tiles.nearest(df, ["s"], "i", ["x", "y"], 4).collect()
    assert len(got) == 1200 and all(q.neighbour == (q["rank"] - 1 if q.i < 290 else 289 + q["rank"]) for q in got)


@pytest.fixture(scope="module")
def walks(spark):
    """Three subjects in two conditions, 120 points each, one every two seconds."""
    r = np.random.default_rng(7)
    rows = []
    for s in ("s1", "s2", "s3"):
        for c in ("rest", "task"):
            x = np.cumsum(r.normal(size=(120, 3)) * 0.1, axis=0)
            rows += [(s, c, i, 2.0 * i, *map(float, p)) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "subject string, condition string, t_idx long, time double, m double, d double, e double").cache()


def test_summaries_reach_roles_families_aliases_and_contrasts(spark, walks):
    """What a producer writes is what its consumers look for: R11 -> D1 -> D2 -> D5 -> T1, and W10 -> D1 -> D2."""
    by, axes = ["subject", "condition"], ["m", "d", "e"]
    wide = reachability.summary(walks, by, "subject string, condition string", axes, 8, time="time").cache()
    tubes_ = [f"tube_{c}" for c in ("log_det", "kappa", "log_eig_var", "d_eff", "dir_entropy", "dir_entropy_norm", "rotation", "q_ratio_h4", "a_operator_norm", "capture_gate")]
    want = {f"{c}_{f}" for c in [*tubes_, "cone_kappa"] for f in ("median", "mean")} | {f"q_ratio_h{h}_median" for h in range(1, 5)} | {f"cone_{c}_h{h}_median" for c in ("log_det", "kappa", "log_eig_var", "d_eff", "dir_entropy", "dir_entropy_norm", "q_ratio") for h in range(1, 5)}
    want |= {f"persistence_{p}{c}_median" for p in ("", "tau_", "hysteresis_") for c in reachability.PERSISTENT} | {f"pred_err_h{h}" for h in range(1, 5)} | {"near_singular_rate", "median_cond", "median_min_eig_over_median_eig"}
    want |= {f"tube_{c}_split_half_{n}" for c in ("log_det", "d_eff") for n in ("a_median", "b_median", "rho", "n")}
    assert want <= set(wide.columns)
    long = metrics.role_and_family(metrics.melt(wide, by)).cache()
    kind = {r.metric: (r.metric_role, r.metric_family) for r in long.select("metric", "metric_role", "metric_family").distinct().collect()}
    assert kind["tube_capture_gate_median"] == ("signal", "reachability") and kind["cone_kappa_mean"] == ("signal", "reachability") and kind["pred_err_h2"][0] == "qc" and kind["n_windows"][0] == "qc"
    aliases = metrics.publish_aliases(long.withColumn("row", F.monotonically_increasing_id()), by, "row")
    named = {(r.subject, r.condition, r.metric): r.value for r in aliases.collect()}
    first = {(r.subject, r.condition): r for r in wide.collect()}
    assert len(named) == 18 and all(v == pytest.approx({"q_ratio_h4": first[s, c].q_ratio_h4_median, "capture_gate": first[s, c].tube_capture_gate_median, "a_operator_norm": first[s, c].tube_a_operator_norm_median}[m]) for (s, c, m), v in named.items())
    pairs = spark.createDataFrame([("rest_task", "rest", "task")], "contrast_name string, left string, right string")
    ready = aliases.withColumn("ok", F.lit(True))
    out = contrasts.paired_contrast(contrasts.collapse(ready, pairs, ["metric"], ["subject"]), ["metric"]).collect()
    assert {r.metric for r in out} == {"q_ratio_h4", "capture_gate", "a_operator_norm"} and all(r.n_pairs == 3 for r in out)
    table = metrics.role_and_family(metrics.melt(sequences.dynamics(walks, by, axes, 2.0), by))
    families = {r.metric: r.metric_family for r in table.select("metric", "metric_family").distinct().collect()}
    trajectory_ = {"speed_median", "curvature_median", "path_length", "endpoint_dist", "traj_efficiency", "corner_entropy", "corner_dwell_entropy", "corner_transition_entropy", "m_tau_sec", "e_delta_mean_median"}
    assert all(families[m] == "trajectory" for m in trajectory_)


def test_times_of_strided_sessions(spark, walks):
    """With a step of two seconds and a stride of three, return times are multiples of six seconds, hysteresis in seconds too."""
    one = sequences.stride(walks, ["subject", "condition"], 40).withColumn("v", F.abs(F.col("m")))
    steps = sequences.return_time(one, ["subject", "condition"], "v").where("return_time is not null").orderBy("subject", "condition", "t_idx").collect()
    seconds = sequences.return_time(one, ["subject", "condition"], "v", time="time").where("return_time is not null").orderBy("subject", "condition", "t_idx").collect()
    assert [6.0 * r.return_time for r in steps] == [r.return_time for r in seconds] and len(steps) > 5
    plain = {(r.subject, r.condition, r.t_idx): r.gap for r in sequences.hysteresis(one, ["subject", "condition"], "v").collect()}
    timed = {(r.subject, r.condition, r.t_idx): r.gap for r in sequences.hysteresis(one, ["subject", "condition"], "v", time="time").collect()}
    assert all(timed[k] == (None if g is None else pytest.approx(6.0 * g)) for k, g in plain.items())
    tube = one.withColumnRenamed("t_idx", "window").select("subject", "condition", "window", "time", *[F.col("v").alias(f"tube_{c}") for c in reachability.PERSISTENT])
    p, q = (reachability.persistence(tube, ["subject", "condition"], time=t).orderBy("subject", "condition").collect() for t in (None, "time"))
    assert all(a.persistence_tau_kappa_median is None or 6.0 * a.persistence_tau_kappa_median == pytest.approx(b.persistence_tau_kappa_median) for a, b in zip(p, q, strict=True))


def test_split_halves_keep_places(spark):
    rows = [("a", i, v) for i, v in enumerate([1.0, None, 3.0, 4.0, 9.0, 8.0, None, 6.0, 5.0])] + [("b", i, float(i)) for i in range(3)] + [("c", 0, None)]
    got = {r.s: r for r in sequences.split_half(spark.createDataFrame(rows, "s string, t_idx long, v double"), ["s"], "v").collect()}
    a = got["a"]
    assert (a.n, a.a_median, a.b_median, a.rho) == (2, 3.0, 8.0, None)  # halves 1 - 3 4 and 9 8 - 6
    assert all((got[s].n, got[s].a_median, got[s].rho) == (0, None, None) for s in "bc")


def test_draws_are_the_same_everywhere(spark, duck):
    """Columns, arrays and the oracle's dialect give the same numbers; they spread evenly over replicates and items."""
    keys = [0, 1, 77, 2**31, 2**32 - 1]
    got = spark.createDataFrame([(k, r) for k in keys for r in range(40)], "k long, r int").select("k", "r", resample.draw(F.col("k"), F.col("r")).alias("h")).collect()
    want = resample.draws(np.array(keys), np.arange(40))
    assert all(q.h == want[q.r, keys.index(q.k)] for q in got)
    items = spark.range(30).select("id", resample.item_key(3, "id", "salt").alias("key")).orderBy("id").collect()
    told = duck.execute(f"select i, r, {resample.draw_sql(3, 'r', 'i', 'salt')} from range(30) a(i), range(20) b(r)").fetchall()
    h = resample.draws(np.array([q.key for q in items]), np.arange(20))
    assert all(h[r, i] == x for i, r, x in told)
    many = resample.draws(np.arange(2000) * 2654435761 % 2**32, np.arange(500)) / 2**32
    assert abs(many.mean() - 0.5) < 0.002 and abs(np.corrcoef(many)[np.triu_indices(500, 1)]).mean() < 0.03


def test_large_groups_give_what_packed_ones_do(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(g, i, float(v), float(v * 0.5 + w), bool(i % 3)) for g in ("a", None) for i, (v, w) in enumerate(r.normal(size=(23, 2)))]
    df = spark.createDataFrame(rows, "g string, i long, v double, w double, lf boolean")
    calls = [
        lambda: stats.label_permutation_p(df.where("g = 'a'"), ["g"], "v", "lf", "i", 40), lambda: stats.bootstrap_ci(df.where("g = 'a'"), ["g"], "v", "i", 40), lambda: stats.bootstrap_dz(df.where("g = 'a'"), ["g"], "v", "i", 40),
        lambda: stats.bootstrap_spearman(df.where("g = 'a'"), ["g"], "v", "w", "i", 40), lambda: stats.median_sign_p(df.where("g = 'a'"), ["g"], "v", "i", 40),
    ]
    packed = [f().collect() for f in calls]
    both = stats.bootstrap_ci(df, ["g"], "v", "i", 40).collect()
    assert len(both) == 2 and stats.paired_permutation_p(df, ["g"], "v", "i", 40).count() == 2
    monkeypatch.setattr(resampling, "PACK", 5)
    for a, b in zip(packed, [f().collect() for f in calls], strict=True):
        assert len(a) == len(b) == 1 and all((x == y) if isinstance(x, (str, bool)) or x is None else x == pytest.approx(y, abs=1e-9) for x, y in zip(a[0], b[0], strict=True)), (a, b)


@pytest.mark.parametrize("band", [8.0, 0.3])
def test_bands_of_large_groups(spark, monkeypatch, band):
    """Groups in several chunks, by narrow bands too, some of whose replicates are done again; ties, null and one-sided groups."""
    monkeypatch.setattr(resampling, "PACK", 64)
    monkeypatch.setattr(resampling, "BAND", band)
    r = np.random.default_rng(11)
    data = {"a": np.round(r.normal(0.2, 1, 701), 1), None: r.normal(size=500), "even": np.r_[r.normal(size=299), 50.0], "left": r.normal(size=90)}
    rows = [(g, i, float(v), g == "left" or bool(i % 3)) for g, vs in data.items() for i, v in enumerate(vs)] + [("a", 9_000, None, True)]
    df = spark.createDataFrame(rows, "g string, i long, v double, lf boolean")
    keys = {r.i: r.key for r in spark.range(701).select(F.col("id").alias("i"), resample.item_key(0, "id", "sign").alias("key")).collect()}
    labels = {r.i: r.key for r in spark.range(701).select(F.col("id").alias("i"), resample.item_key(0, "id", "label").alias("key")).collect()}
    clean = df.where("v is not null")
    medians = {(x.g, x.rep): x.s for x in resampling.flipped_medians(clean, ["g"], "i", 130).collect()}
    sums = {(x.g, x.rep): x.low for x in resampling.left_sums(clean.withColumn("lf", F.col("lf").cast("int")), ["g"], "i", 130).collect()}
    for g, vs in data.items():
        h = resample.draws(np.array([keys[i] for i in range(len(vs))]), np.arange(130))
        want = np.median(np.where(h < 2**31, -vs, vs), axis=1)
        assert [medians[g, k] for k in range(130)] == pytest.approx(list(want), abs=1e-12)
        n_left = sum(bool(i % 3) for i in range(len(vs)))
        h = resample.draws(np.array([labels[i] for i in range(len(vs))]), np.arange(130))
        if g != "left":
            assert [sums[g, k] for k in range(130)] == pytest.approx(list(vs[np.argsort(h, axis=1, kind="stable")[:, :n_left]].sum(1)), abs=1e-9)
    assert len(medians) == 4 * 130 and len(sums) == 3 * 130


def test_one_long_session_by_ranges(spark):
    """Segments, path, dwell and transition entropies of a session in several ranges are those of windows."""
    r = np.random.default_rng(9)
    x = np.cumsum(r.normal(size=(30_000, 3)), axis=0)
    keep = np.flatnonzero(r.random(30_000) > 0.02)
    rows = [("long", int(i), *map(float, x[i])) for i in keep] + [("short", i, *map(float, x[i])) for i in (0, 1, 2, 5)] + [(None, 3, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "s string, t_idx long, m double, d double, e double").repartition(6).cache()
    axes = ["m", "d", "e"]
    told = lambda frame, *columns: sorted(([None if v is None else v if isinstance(v, (str, int)) else round(v, 9) for v in q] for q in frame.select(*columns).collect()), key=repr)
    for f in (lambda large: sequences.segments(df, ["s"], large=large).select("s", "t_idx", "segment"), lambda large: sequences.steps(df, ["s"], axes, large=large).select("s", "t_idx", "speed", "angle")):
        assert told(f(True), "*") == told(f(False), "*")
    a, b = ({q.s: q for q in sequences.path_summary(df, ["s"], axes, large=large).collect()} for large in (True, False))
    assert set(a) == {"long", "short", None} == set(b)
    for s in a:
        assert all(p == q or p == pytest.approx(q, rel=1e-9) for p, q in zip(a[s], b[s], strict=True))
    known = df.where("s is not null")
    codes = [sequences.corner_codes(known, ["s"], axes, levels=sequences.corner_levels(known, ["s"], axes, large=large)).cache() for large in (True, False)]
    assert told(codes[0], "s", "t_idx", "code") == told(codes[1], "s", "t_idx", "code")
    for f in (sequences.dwell_entropy, sequences.transition_entropy):
        assert told(f(codes[0], ["s"], large=True), "s", "entropy") == told(f(codes[1], ["s"]), "s", "entropy")


def test_leave_one_out_with_ties_and_null_keys(spark):
    r = np.random.default_rng(10)
    rows = [(g, i, float(v), float(w)) for g, n in (("a", 60), (None, 12), ("b", 4)) for i, (v, w) in enumerate(r.integers(0, 7, (n, 2)))] + [("a", 90, None, 1.0)]

    def ranks(v):
        return np.array([(v < q).sum() + ((v == q).sum() + 1) / 2 for q in v])

    got = {q.g: q for q in stats.leave_one_out(spark.createDataFrame(rows, "g string, i long, x double, y double"), ["g"], "i", "x", "y").collect()}
    for g in ("a", None):
        v = np.array([q[2:] for q in rows if q[0] == g and q[2] is not None])
        fits = [np.corrcoef(ranks(np.delete(v[:, 0], k)), ranks(np.delete(v[:, 1], k)))[0, 1] for k in range(len(v))] + ([np.corrcoef(ranks(v[:, 0]), ranks(v[:, 1]))[0, 1]] if g == "a" else [])
        assert (got[g].mean_r, got[g].min_r, got[g].max_r) == pytest.approx((np.mean(fits), np.min(fits), np.max(fits))) and got[g].n_fits == len(fits)
    assert got["b"].n_fits == 0
