"""Operators without SQL against small numpy formulas, published values and invariants."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import distributions as dist
from tideline.functions.resample import uniform, uniform_sql
from tideline.operators import contrasts, matrices, reachability, sequences, signals, stats
from tideline.plans import contrasts as contrast_plans
from tideline.plans import reachability as reachability_plans
from tideline.plans import sequences as sequence_plans
from tideline.plans.shapes import signal, trajectory


def test_tails():
    assert dist.normal_two_sided(np.array([1.959963985]))[0] == pytest.approx(0.05, abs=1e-9)
    assert dist.t_two_sided(np.array([2.228138852]), np.array([10.0]))[0] == pytest.approx(0.05, abs=1e-9)
    assert dist.t_two_sided(np.array([0.0, 1.0]), np.array([3.0, 1.0])) == pytest.approx([1.0, 0.5])
    assert dist.chi2_tail(np.array([5.991464547]), 2)[0] == pytest.approx(0.05, abs=1e-9)
    assert dist.chi2_tail(np.array([7.814727903]), 3)[0] == pytest.approx(0.05, abs=1e-9)
    assert dist.chi2_tail(np.array([9.487729037]), 4)[0] == pytest.approx(0.05, abs=1e-9)


def test_signed_rank_published_value():
    # 44 pairs, rank sum 425: exact two-sided p
    assert dist.signed_rank_p(425, 44, 0, True) == pytest.approx(0.42105581, abs=1e-8)
    assert dist.signed_rank_p(0, 5, 0, True) == pytest.approx(2 / 32)


def test_uniform_same_in_both_engines(spark, duck):
    got = [r[0] for r in spark.range(50).select(uniform(3, F.lit(7), "id", "x")).collect()]
    want = [r[0] for r in duck.execute(f"select {uniform_sql(3, '7', 'id', 'x')} from range(50) t(id)").fetchall()]
    assert got == want and 0 <= min(got) and max(got) < 1


def test_wilcoxon_and_friedman(spark):
    diffs = spark.createDataFrame([("g", float(d)) for d in (1, -2, 3, 4, 5, 6)], "g string, diff double")
    r = stats.wilcoxon(diffs, ["g"]).first()
    assert (r.n, r.w) == (6, 2.0) and r.p == pytest.approx(6 / 64)
    rows = [("g", s, c, float(v)) for s in range(10) for c, v in (("a", 1), ("b", 2), ("c", 3))]
    f = stats.friedman(spark.createDataFrame(rows, "g string, s int, c string, v double"), ["g"], "s", "c", "v", 3).first()
    assert f.chi2 == pytest.approx(20) and f.p == pytest.approx(np.exp(-10))


def test_spectra_invariants(spark, data):
    t = trajectory(spark, data).withColumn("j", F.array(*[F.col(f"x{i}") for i in range(9)])).limit(40)
    both = matrices.invariants(t, 3).join(matrices.spectra(t, ["session", "t_idx"], "session int, t_idx long", 3), ["session", "t_idx"]).collect()
    for r in both:
        m = np.array(r.j).reshape(3, 3)
        s, e = np.linalg.svd(m, compute_uv=False), np.linalg.eigvals(m)
        assert r.trace == pytest.approx(e.sum().real) and r.fro**2 == pytest.approx((s**2).sum())
        assert r.op_norm == pytest.approx(s[0]) and r.re_max == pytest.approx(e.real.max()) and r.rotational == pytest.approx(np.abs(e.imag).mean())
        assert r.sym**2 + r.antisym**2 == pytest.approx(r.fro**2)


def test_condition_by_stage(spark):
    rows = [(0, i, [10.0 if i % 2 == 0 else 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "session int, t_idx long, j array<double>").withColumn("stage", (F.col("t_idx") % 2).cast("int"))
    spec = matrices.spectra(df, ["session", "stage", "t_idx"], "session int, stage int, t_idx long", 3)
    got = {r.stage: r.median for r in matrices.condition_summary(spec, ["session", "stage"]).collect()}
    assert got == {0: pytest.approx(10.0), 1: pytest.approx(1.0)}


def test_transverse_and_first_component(spark, data):
    df = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0, [5.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, -1.0])], "session int, t_idx long, m double, d double, e double, j array<double>")
    r = matrices.transverse(df, ["session", "t_idx"], "session int, t_idx long", 3, ["m", "d", "e"]).first()
    assert (r.top, r.positive_sum) == (pytest.approx(2.0), pytest.approx(2.0))
    s = signal(spark, data).where("network = 2 and session = 1")
    x = s.toPandas().pivot(index="t_idx", columns="roi", values="value").sort_index().to_numpy()
    x = x - x.mean(0)
    v = np.linalg.svd(x, full_matrices=False)[2][0]
    v = v * np.sign(v[np.argmax(np.abs(v))])
    got = [r.pc1 for r in signals.first_component(s).orderBy("t_idx").collect()]
    assert got == pytest.approx(list(x @ v), abs=1e-8)


@pytest.mark.parametrize("keys", [["session"], ["session", "stage"]])
def test_matrix_summary_against_numpy(spark, data, keys):
    t = trajectory(spark, data).withColumn("j", F.array(*[F.col(f"x{i}") for i in range(9)])).where("session < 3").withColumn("stage", (F.floor(F.col("t_idx") / 10) % 2).cast("int"))
    types = ", ".join(f"{k} int" for k in keys)
    got = {tuple(r[k] for k in keys): r for r in matrices.matrix_summary(t.select(*keys, "t_idx", "j"), keys, types, 3).collect()}
    rows = t.select(*keys, "t_idx", "j").toPandas().sort_values("t_idx")
    for key, part in rows.groupby(keys):
        r, m = got[key], np.stack(part["j"].tolist()).reshape(-1, 3, 3)
        dot = np.gradient(m, axis=0) if len(m) > 1 else np.zeros_like(m)
        s, e, fro = np.linalg.svd(m, compute_uv=False), np.linalg.eigvals(m), np.linalg.norm(m, axis=(1, 2))
        want = {"trace": m.trace(axis1=1, axis2=2), "fro": fro, "op_norm": s[:, 0], "cond": s[:, 0] / s[:, -1], "rotational": np.abs(e.imag).mean(1), "mdr": np.linalg.norm(dot, axis=(1, 2)) / (fro + 1e-12)}
        assert r.n_windows == len(m)
        for name, v in want.items():
            assert (r[f"{name}_mean"], r[f"{name}_median"]) == (pytest.approx(v.mean(), rel=1e-4), pytest.approx(np.median(v), rel=1e-4)), name


def test_components_and_kappa_against_numpy(spark, data):
    t = trajectory(spark, data)
    x = t.orderBy("session", "t_idx").select(*[f"x{i}" for i in range(9)]).toPandas().to_numpy()
    v = np.linalg.eigh(np.cov(x, rowvar=False))[1][:, ::-1][:, :3]
    got = matrices.principal_components(t, [f"x{i}" for i in range(9)], 3).orderBy("session", "t_idx").select("pc0", "pc1", "pc2").toPandas().to_numpy()
    assert np.abs(got) == pytest.approx(np.abs(x @ v), abs=1e-6)
    kappa = {r.session: r.kappa for r in matrices.covariance_kappa(t, ["session"], "session int", ["m", "d", "e"]).collect()}
    for session, part in t.select("session", "m", "d", "e").toPandas().groupby("session"):
        e = np.linalg.eigvalsh(np.cov(part[["m", "d", "e"]].to_numpy(), rowvar=False))
        assert kappa[session] == pytest.approx(e[-1] / (e[0] + 1e-9), rel=1e-6)


def test_contrast_driver_against_loops(spark):
    """Exact p up to 16 pairs, random signs beyond; q within a contrast; intervals hold the mean."""
    rng, rows = np.random.default_rng(3), []
    for metric, n, shift in (("a", 9, 0.8), ("b", 14, 0.1), ("c", 40, 0.6)):
        for s in range(n):
            rows += [(metric, s, "l", float(rng.normal()), True), (metric, s, "r", float(rng.normal() + shift), True)]
    m = spark.createDataFrame(rows, "metric string, subject int, condition string, value double, ok boolean")
    c = spark.createDataFrame([("lr", "l", "r")], "contrast_name string, left string, right string")
    got = {r.metric: r for r in contrasts.drive(m, c, ["metric"], "subject", 200).collect()}
    for metric in "abc":
        v = {(s, k): x for a, s, k, x, _ in rows if a == metric for k in [k]}
        d = np.array([v[s, "r"] - v[s, "l"] for s in sorted({s for s, _ in v})])
        if len(d) <= 16:
            sums = np.abs(((np.arange(2 ** len(d))[:, None] >> np.arange(len(d))) % 2 * -2 + 1) @ d)
            assert got[metric].p == pytest.approx(((sums >= abs(d.sum()) - 1e-9).sum() + 1) / (len(sums) + 1))
        assert got[metric].ci_low < d.mean() < got[metric].ci_high
    p = sorted((got[x].p, x) for x in "abc")
    q = np.minimum.accumulate([p[i][0] * 3 / (i + 1) for i in (2, 1, 0)])[::-1]
    assert [got[x].q for _, x in p] == pytest.approx(np.minimum(q, 1).tolist())


def test_transport_ratio_against_cones(spark, data):
    got = {r.session: r for r in reachability_plans.t28(spark, data).collect()}
    cone = reachability.cones(reachability_plans._models(spark, data), ["session"], "session int", 3).toPandas()
    want = cone.groupby(["session", "h"])["q_ratio"].median()
    for s in got:
        assert [got[s][f"q_ratio_h{h}"] for h in range(1, 5)] == pytest.approx([want[s, h] for h in range(1, 5)], abs=2e-6)


AXES = ["m", "d", "e"]


def _points(spark):
    rng = np.random.default_rng(1)
    a = np.array([[0.9, -0.2, 0.0], [0.2, 0.9, 0.0], [0.0, 0.1, 0.8]])
    x = [rng.normal(size=3)]
    for _ in range(79):
        x.append(a @ x[-1] + 0.05 * rng.normal(size=3))
    x = np.array(x)
    return x, spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(x)], "session int, t_idx long, m double, d double, e double")


def _windows(x, k, last):
    near = np.argsort(np.round(((x[:, None] - x[None]) ** 2).sum(-1), 9), axis=1, kind="stable")[:, :k]
    return lambda w: sorted({int(j) for i in range(w, w + 3) for j in near[i] if j <= last})


def _ridge_fit(p, q, alpha):
    pc, qc = p - p.mean(0), q - q.mean(0)
    a = np.linalg.solve(pc.T @ pc + alpha * np.eye(3), pc.T @ qc).T
    return a, q.mean(0) - a @ p.mean(0)


def _best_alpha(p, q, alphas=(1e-4, 1e-3, 1e-2, 1e-1), folds=5):
    if len(p) // folds < 2:
        return alphas[0], None
    parts, scores = np.array_split(np.arange(len(p)), folds), []  # contiguous, the larger ones first
    for alpha in alphas:
        r2 = []
        for test in parts:
            train = np.setdiff1d(np.arange(len(p)), test)
            a, b = _ridge_fit(p[train], q[train], alpha)
            res, dev = q[test] - p[test] @ a.T - b, q[test] - q[test].mean(0)
            r2.append((1 - (res**2).sum(0) / (dev**2).sum(0)).mean())
        scores.append(np.mean(r2))
    return alphas[int(np.argmax(scores))], max(scores)


@pytest.mark.parametrize("k", [3, 12])
def test_local_models_against_numpy(spark, k):
    x, df = _points(spark)
    cells = reachability.fold_moments(reachability.transitions(df, ["session"], AXES, k), ["session"], AXES)
    models = reachability.local_models(cells, ["session"], "session int", 3)
    cone = {(r.window, r.h): r for r in reachability.cones(models, ["session"], "session int", 3).collect()}
    chosen = {r.window: (r.alpha, r.cv_r2) for r in reachability.choose_alpha(cells, ["session"], "session int", 3).collect()}
    members, seen = _windows(x, k, 78), set()
    for r in models.collect():
        ids = members(r.window)
        p, q = x[ids], x[[i + 1 for i in ids]]
        alpha, score = _best_alpha(p, q)
        assert r.alpha == pytest.approx(alpha) and chosen[r.window] == (pytest.approx(alpha), score if score is None else pytest.approx(score, abs=1e-7))
        seen.add(alpha)
        a, b = _ridge_fit(p, q, alpha)
        res = q - p @ a.T - b
        cov = np.cov(res, rowvar=False) + 1e-8 * np.eye(3)
        assert r.n == len(ids) and r.a == pytest.approx(list(a.ravel()), abs=1e-7) and r.b == pytest.approx(list(b), abs=1e-7)
        assert r.q == pytest.approx(list(cov.ravel()), abs=1e-9)
        assert r.r2 == pytest.approx(float(1 - (res**2).sum() / (((q - q.mean(0)) ** 2).sum() + 1e-10)), abs=1e-8)
        sigma = np.eye(3) * 1e-6
        for h in range(1, 5):
            moved = a @ sigma @ a.T
            sigma = moved + cov + 1e-8 * np.eye(3)
            c = cone[r.window, h]
            e = np.linalg.eigvalsh(sigma)
            assert c.kappa == pytest.approx(e[-1] / e[0], rel=1e-4) and c.log_det == pytest.approx(0.5 * np.log(e).sum(), rel=1e-4)
            assert c.q_ratio == pytest.approx(1 - np.trace(moved) / np.trace(sigma), abs=1e-7) and c.dir_entropy <= np.log(3) + 1e-9
    assert len(seen) > (1 if k == 12 else 0)


def test_oas(spark):
    _, df = _points(spark)
    cells = reachability.fold_moments(reachability.transitions(df, ["session"], AXES, 12), ["session"], AXES)
    oas = reachability.local_models(cells, ["session"], "session int", 3, covariance="oas").collect()
    assert len(oas) == 78 and all(np.all(np.linalg.eigvalsh(np.array(r.q).reshape(3, 3)) > 0) for r in oas)


def test_prediction_error_against_numpy(spark):
    x, df = _points(spark)
    models = reachability.local_models(reachability.fold_moments(reachability.transitions(df, ["session"], AXES, 12), ["session"], AXES), ["session"], "session int", 3)
    errors = {h: [] for h in range(1, 5)}
    for r in models.collect():
        p = x[r.center]
        for h in range(1, 5):
            if r.center + h < 80:
                p = np.array(r.a).reshape(3, 3) @ p + np.array(r.b)
                errors[h].append(np.linalg.norm(x[r.center + h] - p))
    got = reachability.prediction_error(df, models, ["session"], AXES).first()
    assert [got[f"pred_err_h{h}"] for h in range(1, 5)] == pytest.approx([np.median(errors[h]) for h in range(1, 5)])


def test_summary_of_a_session(spark):
    """Tubes, health, persistence and cone columns from the cones' rows; shape indices run on them."""
    x, df = _points(spark)
    models = reachability.local_models(reachability.fold_moments(reachability.transitions(df, ["session"], AXES, 12), ["session"], AXES), ["session"], "session int", 3)
    cone = reachability.cones(models, ["session"], "session int", 3).toPandas().sort_values(["window", "h"])
    r = reachability.summary(df, ["session"], "session int", AXES, 12).first().asDict()
    by = cone.groupby("window")
    tube = by[reachability.CONE].median()
    gate = (1 - by["q_ratio"].last()) * np.log1p(by["tube_a_operator_norm"].max())
    assert r["n_windows"] == 78 and r["tube_capture_gate_median"] == pytest.approx(gate.median()) and r["tube_kappa_median"] == pytest.approx(tube["kappa"].median())
    assert r["near_singular_rate"] == pytest.approx(cone["near_singular"].mean()) and r["median_cond"] == pytest.approx(cone["cond"].median())
    assert r["median_min_eig_over_median_eig"] == pytest.approx(cone["min_eig_over_median_eig"].median())
    for h in range(1, 5):
        assert r[f"cone_q_ratio_h{h}_median"] == pytest.approx(cone.loc[cone["h"] == h, "q_ratio"].median())
    v = tube["log_det"].to_numpy()
    stable = [1 / (v[max(0, i - 5) : i + 6].std() + 1e-10) for i in range(len(v))]
    assert r["persistence_log_det_median"] == pytest.approx(np.median(stable)) and r["cone_kappa_median"] == pytest.approx(np.median(np.exp(np.diff(v))))
    assert r["tube_log_det_split_half_a_median"] == pytest.approx(np.median(v[: len(v) // 2])) and r["tube_log_det_split_half_b_median"] == pytest.approx(np.median(v[len(v) // 2 : 2 * (len(v) // 2)]))
    shape = reachability.shape_indices(spark.createDataFrame([r])).first()
    assert shape.endpoint_ovality == pytest.approx(np.log10(max(r["cone_kappa_h4_median"], 1)))


def test_hysteresis_against_numpy(spark):
    rng = np.random.default_rng(2)
    v, t = np.round(rng.normal(size=30), 1), np.cumsum(rng.integers(1, 4, 30)).astype(float)
    dif, want = np.diff(v, prepend=v[0]), []
    for i in range(30):
        lo, hi = max(0, i - 3), min(30, i + 4)
        down, up = v[lo:hi][dif[lo:hi] < 0], v[lo:hi][dif[lo:hi] > 0]
        want.append(abs(np.median(down) - np.median(up)) if len(down) and len(up) else None)
    df = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(v, t, strict=True))], "session int, t_idx long, v double, t double")
    got = [r.gap for r in sequences.hysteresis(df, ["session"], "v", 6).orderBy("t_idx").collect()]
    assert got == [x if x is None else pytest.approx(x) for x in want]
    timed = [r.gap for r in sequences.hysteresis(df, ["session"], "v", 7, time="t").orderBy("t_idx").collect()]
    assert timed == [x if x is None else pytest.approx(x * s) for x, s in zip(want, np.gradient(t), strict=True)]


def test_autocorrelation_edges(spark):
    rows = [(0, i, 0.1) for i in range(9)] + [(1, i, float(i)) for i in range(5)] + [(2, i, float(i % 2)) for i in range(4)] + [(3, i, float(v)) for i, v in enumerate([5, 5, 5, 5, -5, 5])]
    got = {r.s: r.tau for r in sequences.autocorrelation_time(spark.createDataFrame(rows, "s int, t_idx long, v double"), ["s"], "v", 2.0).collect()}
    x = np.arange(5.0) - 2
    lag = next((k for k in range(1, 5) if (x[:-k] * x[k:]).sum() / 10 < np.exp(-1)), 4)
    assert got == {0: None, 1: 2.0 * lag, 2: None, 3: 2.0}
    capped = sequences.autocorrelation_time(spark.createDataFrame([(0, i, float(i)) for i in range(200)], "s int, t_idx long, v double"), ["s"], "v", 100.0).first().tau
    assert capped == 300.0  # three lags, none under 1/e


def test_stage_slices_take_levels_of_the_session(spark):
    rows = [(0, i, float(i), float(i), float(i)) for i in range(40)]
    t = spark.createDataFrame(rows, "session int, t_idx long, m double, d double, e double").withColumn("stage", F.floor(F.col("t_idx") / 20).cast("int"))
    s = sequences.stage_slices(t, "session", "stage", {0: "n1", 1: "n2"}, 10)
    got = {r.slice: r for r in sequences.dynamics(s, ["slice"], AXES, 2.0, least=10, session=["session"], levels=sequences.corner_levels(t, ["session"], AXES)).collect()}
    # the whole first stage is under the session's 60 % point: one code
    assert got["0:stage_n1"].corner_entropy == pytest.approx(0, abs=1e-9) and got["0:stage_n2"].corner_entropy > 0.4
    assert got["0:stage_n1"].speed_median == pytest.approx(np.sqrt(3)) and got["0:stage_n1"].speed_mad == pytest.approx(0, abs=1e-9) and got["0:stage_n1"].finite_ok and not got["0:stage_n1"].not_testable


def test_stage_dynamics_query(spark, data):
    """Levels come from the whole session, matrices from the slice."""
    got = {r.slice: r for r in sequence_plans.w11(spark, data).collect()}
    t = trajectory(spark, data).toPandas().sort_values(["session", "t_idx"])
    t["stage"] = (t["t_idx"] // 10 % 3).map({0: "n1", 1: "n2", 2: "rem"})
    checked = 0
    for (session, stage), part in t.groupby(["session", "stage"]):
        if len(part) < 10:
            continue
        level = t.loc[t["session"] == session, AXES].quantile(0.6)
        code = sum((part[a] >= level[a] - 1e-12).astype(int) * 2**i for i, a in enumerate(AXES))
        p = np.clip(np.bincount(code, minlength=8) / len(part), 1e-12, 1)
        p = p / p.sum()
        m = part[[f"x{i}" for i in range(9)]].to_numpy().reshape(-1, 3, 3)
        s = np.linalg.svd(m, compute_uv=False)
        r = got[f"{session}:stage_{stage}"]
        assert r.corner_entropy == pytest.approx(-(p * np.log(p)).sum(), abs=2e-6) and r.tier2_jacobian_condition_number_median == pytest.approx(np.median(s[:, 0] / s[:, -1]), rel=1e-4)
        axis = np.stack([m[:, 2, 1] - m[:, 1, 2], m[:, 0, 2] - m[:, 2, 0], m[:, 1, 0] - m[:, 0, 1]], 1) / 2
        assert r.tier2_jacobian_rotation_coherence_mrl == pytest.approx(np.linalg.norm((axis / np.linalg.norm(axis, axis=1, keepdims=True)).mean(0)), abs=2e-6)
        checked += 1
    assert checked == len(got) > 0


def test_return_time_and_fdr_against_loops(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.exponential(size=60), 2)
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(v)], "s int, t_idx long, v double")
    med = np.median(v)
    want = [next((j - i for j in range(i + 1, 60) if v[j] >= 0.9 * med), None) if v[i] < 0.8 * med else None for i in range(60)]
    assert [r.return_time for r in sequences.return_time(df, ["s"], "v").orderBy("t_idx").collect()] == want
    p = np.round(rng.random(60), 2)
    order = np.lexsort((np.arange(60), p))
    q = np.minimum.accumulate((p[order] * 60 / np.arange(1, 61))[::-1])[::-1]
    got = {r.id: r.q for r in stats.benjamini_hochberg(spark.createDataFrame([("g", i, float(x)) for i, x in enumerate(p)], "g string, id int, p double"), ["g"], "p", "id").collect()}
    assert [got[i] for i in order.tolist()] == pytest.approx(np.minimum(q, 1).tolist())


def test_large_groups_equal_windows(spark):
    """Ranks and q values by ranges are those of plain windows, with ties, nulls and null keys."""
    rng = np.random.default_rng(9)
    rows = [(None if g == 2 else g, i, None if rng.random() < 0.05 else float(rng.integers(0, 40)) / 40, float(rng.integers(0, 9))) for g in range(3) for i in range(300 if g else 5)]
    df = spark.createDataFrame(rows, "g int, i int, p double, y double").repartition(5)
    for one in (False, True):
        for by in (["g"], []):
            want = {(r.g, r.i): r.q for r in stats.benjamini_hochberg(df.withColumn("tie", F.coalesce("g", F.lit(9)) * 1000 + F.col("i")), by, "p", "tie", one).collect()}
            got = {(r.g, r.i): r.q for r in stats.fdr_of_rows(df.withColumn("tie", F.coalesce("g", F.lit(9)) * 1000 + F.col("i")), by, "p", "tie", one).collect()}
            assert len(got) == len(rows) and got.keys() == want.keys()
            assert all((got[k] is None and want[k] is None) or got[k] == pytest.approx(want[k]) for k in want)
    small, large = ({r.g: (r.n, r.r) for r in stats.spearman(df, ["g"], "p", "y", large=x).collect()} for x in (False, True))
    assert small.keys() == large.keys() and all(small[k][0] == large[k][0] and small[k][1] == pytest.approx(large[k][1]) for k in small)


def test_leave_one_out_against_loops(spark):
    rng = np.random.default_rng(6)
    rows = [(g, i, None if i == 3 else float(rng.integers(0, 7 if g else 1000)), None if i == 5 else float(rng.integers(0, 5 if g else 1000))) for g in (0, 1) for i in range(37)]
    rows += [(2, i, float(i), 1.0) for i in range(9)] + [(3, i, float(i), float(-i)) for i in range(5)]
    got = {r.g: r for r in stats.leave_one_out(spark.createDataFrame(rows, "g int, i int, x double, y double"), ["g"], "i", "x", "y").collect()}

    def rank(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    for g in range(4):
        r = []
        for left in [i for h, i, *_ in rows if h == g]:
            xy = np.array([(x, y) for h, i, x, y in rows if h == g and i != left and x is not None and y is not None])
            if len(xy) >= 5 and xy[:, 0].std() > 0 and xy[:, 1].std() > 0:
                r.append(np.corrcoef(rank(xy[:, 0]), rank(xy[:, 1]))[0, 1])
        assert got[g].n_fits == len(r)
        if r:
            assert (got[g].mean_r, got[g].min_r, got[g].max_r) == (pytest.approx(np.mean(r)), pytest.approx(min(r)), pytest.approx(max(r)))


def test_incremental_auc(spark):
    from tideline.operators import models

    rng = np.random.default_rng(8)
    rows = [(i, int(i % 4 == 0), float(rng.normal()), float(rng.normal() + 2.5 * (i % 4 == 0))) for i in range(400)]
    df = spark.createDataFrame([*rows, (400, 1, None, 0.0)], "id int, y int, noise double, signal double")
    folds = models.stratified_folds(df.where("id < 400"), "id", "y", 5).groupBy("fold", "y").count().collect()
    assert {r["count"] for r in folds if r.y} == {20} and {r["count"] for r in folds if not r.y} == {60}
    got = {r.model: r for r in models.incremental_auc(df, "id", "y", ["noise"], ["signal"]).collect()}
    assert got["full"].auc > 0.93 and abs(got["base"].auc - 0.5) < 0.12 and got["full"].auc_sd < 0.06 and got["full"].n == 400 and got["full"].n_class == 100
    few = models.incremental_auc(df.where("y = 0 or id < 5"), "id", "y", ["noise"], ["signal"]).collect()
    assert [(r.auc, r.n_class) for r in few] == [(None, 2)] * 2


def test_sequence_invariants(spark, data):
    t = trajectory(spark, data, 3)
    c = sequences.corner_codes(t, ["session"], AXES)
    a = {r.session: r.entropy for r in sequences.occupancy_entropy(c, ["session"]).collect()}
    b = {r.session: r.entropy for r in sequences.dwell_entropy(c, ["session"]).collect()}
    assert a == pytest.approx(b) and max(a.values()) <= np.log(8) + 1e-9
    centred = sequences.centre(t, ["session"], ["m"]).groupBy("session").agg(F.median("m_sc").alias("m")).collect()
    assert all(abs(r.m) < 1e-12 for r in centred)
    flat = spark.createDataFrame([(0, i, 1.0) for i in range(6)], "session int, t_idx long, v double")
    assert {r.z_v for r in sequences.robust_z(flat, ["session"], "v").collect()} == {0.0}
    assert {r.n for r in sequences.logistic_normalise(flat, ["session"], {"v": "n"}).collect()} == {0.5}


def test_q_at_least_p(spark, data):
    p = spark.range(40).select(F.lit("g").alias("g"), "id", ((F.col("id") * 7 % 40 + 1) / 50.0).alias("p"))
    assert all(r.q >= r.p - 1e-12 for r in stats.benjamini_hochberg(p, ["g"], "p", "id").collect())


def test_signed_rank_query_uses_all_subjects(spark, data):
    d = str(Path(data).parent / "sf0.01")
    want = {(r.contrast_name, r.metric): (r.n, r.w) for r in contrast_plans.t11(spark, d).collect()}
    got = {(r.contrast_name, r.metric): (r.n, r.w) for r in contrast_plans.t11p(spark, d).collect()}
    assert got == want and max(n for n, _ in want.values()) > 50


def long_sessions(spark, folder, n):
    """Embeddings of one slow session of ``n`` rows."""
    rows = [(i, 0, [float(np.cos(i / 60)), float(np.sin(i / 7)), i % 13 / 13] + [float(np.sin(i * j)) for j in range(1, 7)]) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize(("n", "kept"), [(450, 450), (2500, 1250)])
def test_reachability_keeps_up_to_2000_points(spark, tmp_path, n, kept):
    assert reachability_plans.points(spark, long_sessions(spark, tmp_path, n)).count() == kept


def test_transitions_of_a_long_session_equal_brute_force(spark, tmp_path):
    n = 260
    d = long_sessions(spark, tmp_path, n)
    x = np.array([[r.m, r.d, r.e] for r in trajectory(spark, d, 3).orderBy("t_idx").collect()])
    near = [sorted(range(n), key=lambda j, i=i: (round(float(((x[i] - x[j]) ** 2).sum()), 9), j))[:8] for i in range(n)]
    want = {(w, s) for w in range(n - 2) for i in range(w, w + 3) for s in near[i] if s + 1 < n}
    assert {(r.window, r.source) for r in reachability_plans.r1(spark, d).collect()} == want


def test_autocorrelation_time_of_a_slow_session(spark, tmp_path):
    d = long_sessions(spark, tmp_path, 450)
    x = np.array([r.m for r in trajectory(spark, d, 3).where("m is not null").orderBy("t_idx").collect()])
    x = x - x.mean()
    lag = next((k for k in range(1, 151) if (x[:-k] * x[k:]).sum() / (x * x).sum() < np.exp(-1)), 150)
    assert lag > 12 and sequence_plans.w8(spark, d).first().tau == pytest.approx(2.0 * lag)
    assert sequence_plans.w10(spark, d).first().m_tau_sec == pytest.approx(2.0 * lag)
