"""Synthetic control: covariates, chosen penalties and ranks, neighbours and market groups against plain numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions.linalg import simplex_ls
from causeway.operators import synth

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]
P0 = 30


def series(n=7, seed=0):
    rng = np.random.default_rng(seed)
    base = np.cumsum(rng.normal(size=(2, 40)), axis=1)
    load = rng.random((n, 2))
    return 50 + 5 * load @ base + rng.normal(size=(n, 40)), rng.random((n, 1)) * 10


def frame(spark, Y, Z=None):
    rows = [(f"u{u}", DAYS[t], float(Y[u, t]), float(Z[u, 0] + (t % 2) - 0.5) if Z is not None else 0.0) for u in range(len(Y)) for t in range(40)]
    return spark.createDataFrame(rows, "unit string, date date, y double, x double").repartition(4)


def demeaned(Y):
    return Y - Y[:, :P0].mean(axis=1, keepdims=True)


def test_as_many_covariates_as_leave_no_choice():
    """Two donors and a covariate: the weights are the solution of two equations, whatever rounding leaves of the Gram."""
    rng = np.random.default_rng(0)
    for k in range(300):
        Y, z = rng.normal(size=(3, 20)) * 10 ** rng.uniform(0, 7), rng.random((3, 1)) * 100
        Y -= Y.mean(axis=1, keepdims=True)
        want = (z[2, 0] - z[1, 0]) / (z[0, 0] - z[1, 0])
        for model in ("none", "ridge"):
            r = synth._solve_one(["a", "b", "p"], Y @ Y.T, [2], "p", model, 0.1, z)
            assert np.allclose([r[0][2], r[1][2]], [want, 1 - want], rtol=1e-6, atol=1e-6)
            assert np.isclose(r[0][4], np.linalg.norm(Y[2] - want * Y[0] - (1 - want) * Y[1]), rtol=1e-6)


def test_covariate_adjusted_weights(spark):
    Y, Z = series()
    r = synth.synth_impact(frame(spark, Y, Z), "date", "unit", "y", ["u0"], "2024-01-31", duration=10, with_ci=False, covariates=["x"])
    Yd = demeaned(Y)[:, :P0]
    A = np.column_stack([np.ones(6), Z[1:, 0]])
    fit = np.linalg.lstsq(A, Yd[1:], rcond=None)[0]
    left, own = Yd[1:] - A @ fit, Yd[0] - np.array([1.0, Z[0, 0]]) @ fit
    w = simplex_ls(left @ left.T, left @ own)
    want = w + np.linalg.pinv(A).T @ (np.array([1.0, Z[0, 0]]) - A.T @ w)
    got = {x.donor: (x.weight, x.sc_weight) for x in r["weights"].collect()}
    assert np.allclose([got[f"u{k}"][0] for k in range(1, 7)], want, atol=1e-4) and np.allclose([got[f"u{k}"][1] for k in range(1, 7)], w, atol=1e-4)
    assert abs(sum(v[0] for v in got.values()) - 1) < 1e-9 and abs(sum(v[0] * Z[int(k[1:]), 0] for k, v in got.items()) - Z[0, 0]) < 1e-6
    pred = Y[0, :P0].mean() + want @ demeaned(Y)[1:, P0:]
    assert abs(r["impact"].first().ate - (Y[0, P0:] - pred).mean()) < 1e-3


def test_penalty_is_the_one_of_a_plain_loop(spark):
    Y, _ = series(seed=1)
    Yd = demeaned(Y)
    panel, p0, _, _ = synth.prepare_panel(frame(spark, Y), "date", "unit", "y", "2024-01-31", 10)
    before = panel.filter(F.col("idx") < p0)
    gram = synth.donor_gram(before)
    for treated in (["u0"], None):
        got = {r.treated: r.lam for r in synth.ridge_lambdas(synth.ridge_errors(gram, before, treated)).collect()}
        assert set(got) == ({"u0"} if treated else {f"u{k}" for k in range(7)})
        for u, lam in got.items():
            j = int(u[1:])
            D = np.delete(Yd[:, :P0], j, axis=0)
            path = synth.penalty_path(D @ D.T)
            errors = np.zeros(len(path))
            for t in range(P0):
                Dt, yt = np.delete(D, t, axis=1), np.delete(Yd[j, :P0], t)
                w = simplex_ls(Dt @ Dt.T, Dt @ yt)
                for k, l_ in enumerate(path):
                    a = w + np.linalg.solve(Dt @ Dt.T + l_ * np.eye(6), Dt @ yt - Dt @ Dt.T @ w)
                    errors[k] += (Yd[j, t] - a @ D[:, t]) ** 2
            assert abs(lam / path[int(errors.argmin())] - 1) < 1e-6, u


def test_rank_is_the_one_of_a_plain_loop():
    rng = np.random.default_rng(2)
    for true in (0, 1, 3):
        f = np.linalg.qr(rng.normal(size=(30, 6)))[0]
        y = f[:, :true] @ (5 + rng.random(true)) + 0.05 * rng.normal(size=30)
        errors = [np.mean(y ** 2)]
        for r in range(1, 6):
            e = []
            for t in range(30):
                keep = np.arange(30) != t
                e.append(y[t] - f[t, :r] @ np.linalg.lstsq(f[keep, :r], y[keep], rcond=None)[0])
            errors.append(np.mean(np.square(e)))
        assert synth._loo_rank(f, y, 5) == int(np.argmin(errors)) and (true == 0 or synth._loo_rank(f, y, 5) >= true)


def full_dtw(x, z, window=None):
    n, m = len(x), len(z)
    w = max(window if window is not None else max(n, m), abs(n - m))
    D = np.full((n + 1, m + 1), np.inf)
    D[0, 0] = 0.0
    for i in range(1, n + 1):
        for j in range(max(1, i - w), min(m, i + w) + 1):
            D[i, j] = abs(x[i - 1] - z[j - 1]) + min(D[i - 1, j], D[i, j - 1], D[i - 1, j - 1])
    return D[n, m]


@pytest.mark.parametrize("window", [None, 0, 1, 4])
def test_diagonal_recursion_equals_the_full_one(window):
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (1, 5), (6, 4), (12, 12), (9, 15)):
        x, zs = rng.normal(size=n), rng.normal(size=(4, m))
        want = [full_dtw(x, z, window) for z in zs]
        assert np.allclose(synth._dtw_many(x, zs, window), want)
        low = synth._dtw_many(x, zs, window, stop_above=min(want))
        assert np.isinf(low).all() or np.allclose(low, want)


@pytest.mark.parametrize("measure, window, block", [("corr", None, 256), ("corr", None, 3), ("dtw", 3, 4), ("dtw", None, 256)])
def test_neighbours_against_all_pairs(spark, measure, window, block):
    Y, _ = series(11, seed=4)
    got = {}
    for r in synth.neighbours(frame(spark, Y), 3, measure, window=window, block=block).collect():
        got.setdefault(r.unit, []).append((r.rank, r.other, r.score))
    for u in range(11):
        score = {f"u{v}": (np.corrcoef(Y[u], Y[v])[0, 1] if measure == "corr" else full_dtw(Y[u], Y[v], window)) for v in range(11) if v != u}
        want = sorted(score, key=lambda k: (-score[k] if measure == "corr" else score[k], k))[:3]
        assert [o for _, o, _ in sorted(got[f"u{u}"])] == want and np.allclose([s for _, _, s in sorted(got[f"u{u}"])], [score[k] for k in want])


def test_constant_series_have_no_correlation(spark):
    Y, _ = series(3)
    Y[1] = 7.0
    assert {(r.unit, r.other) for r in synth.neighbours(frame(spark, Y), 2).collect()} == {("u0", "u2"), ("u2", "u0")}


def test_groups_of_several_sizes(spark):
    Y, _ = series(6, seed=5)
    panel = frame(spark, Y)
    near = {u: [o for _, o in sorted((r.rank, r.other) for r in synth.neighbours(panel, 2).collect() if r.unit == u)] for u in (f"u{k}" for k in range(6))}
    want = {"+".join(sorted([u, *near[u][:n - 1]])) for u in near for n in (1, 2, 3)}
    rows = synth.market_groups(panel, [1, 2, 3]).collect()
    assert {r.treated for r in rows} == want and all(r.unit in r.treated.split("+") for r in rows) and len(rows) == sum(len(g.split("+")) for g in want)
    some = {r.treated for r in synth.market_groups(panel, [2], candidates=["u0", "u1", "u2", "u3"]).collect()}
    assert some == {g for g in want if g.count("+") == 1 and not {"u4", "u5"} & set(g.split("+"))}
    given = spark.createDataFrame([("u0", "u5", 1), ("u5", "u0", 1)], "unit string, other string, rank int")
    assert {r.treated for r in synth.market_groups(panel, [2], similarity=given).collect()} == {"u0+u5"}


def test_power_with_random_choices_of_dates(spark):
    Y, Z = series(6, seed=6)
    d = frame(spark, Y, Z)
    run = lambda **k: {(r.candidate, r.effect): r for r in synth.market_power(d, "date", "unit", "y", duration=5, effects=[0.0, 2.0], **k)["power"].collect()}
    a = run(ns=300, side="one_sided", n_markets=[1, 2], covariates=["x"])
    assert all(r.power == 1.0 for (_, e), r in a.items() if e == 2.0) and any("+" in c for c, _ in a) and any("+" not in c for c, _ in a)
    plain, scaled = run(), run(normalize=True)
    assert all(abs(plain[k].avg_incremental - scaled[k].avg_incremental) < 1e-2 * (1 + abs(plain[k].avg_incremental)) and plain[k].power == scaled[k].power for k in plain)
    none = run(side="one_sided", alpha=0.3)
    assert sum(r.power for (_, e), r in none.items() if e == 0.0) <= 5


def refit_by_hand(Y, j, theta, p0, T):
    """p-value of the effect theta: two donors, so the weight is a projection cut to [0, 1]."""
    post = (np.arange(T) >= p0).astype(float)
    own = Y[j, :T] - theta * post
    own = own - own.mean()
    a, b = (Y[i, :T] - Y[i, :T].mean() for i in range(3) if i != j)
    w = np.clip((own - b) @ (a - b) / ((a - b) @ (a - b)), 0, 1)
    u = own - w * a - (1 - w) * b
    sums = np.array([abs(u[(np.arange(p0, T) + s) % T].sum()) for s in range(T)])
    return (sums >= sums[0] - 1e-9).mean()


@pytest.mark.parametrize("treated", [["u1"], None])
def test_weights_refitted_under_each_null(spark, treated):
    Y, _ = series(n=3, seed=4)
    Y[1, P0:] += 25.0
    r = synth.synth_impact(frame(spark, Y), "date", "unit", "y", treated, "2024-01-31", duration=10, refit=True, grid_size=41)
    rows = r["tests"].collect()
    assert len(rows) == 42 * (1 if treated else 3) and all(x.n_shifts == 40 for x in rows)
    for x in rows:
        assert abs(x.p_value - refit_by_hand(Y, int(x.unit[1:]), x.theta, P0, 40)) < 1e-9
    impact = {x.unit: x for x in r["impact"].collect()}["u1"]
    mine = {x.step: x for x in rows if x.unit == "u1"}
    kept = [s for s, x in mine.items() if s >= 0 and x.p_value >= 0.1]
    assert impact.p_value == mine[-1].p_value < 0.1 and mine[-1].theta == 0.0
    assert impact.ate_lower == (mine[min(kept)].theta if min(kept) > 0 else None) and impact.ate_upper == (mine[max(kept)].theta if max(kept) < 40 else None)


def test_refitted_interval_holds_a_planted_effect(spark):
    Y, _ = series(n=3, seed=4)
    Y[1] = 0.3 * Y[0] + 0.7 * Y[2] + np.random.default_rng(6).normal(size=40)
    Y[1, P0:] += 5.0
    r = synth.synth_impact(frame(spark, Y), "date", "unit", "y", ["u1"], "2024-01-31", duration=10, refit=True)["impact"].first()
    assert r.p_value < 0.1 and 0 < r.ate_lower < 5 < r.ate_upper < 10


def test_refit_with_many_donors_equals_plain_solves(spark):
    Y, _ = series(n=6, seed=5)
    panel, p0, p1, T = synth.prepare_panel(frame(spark, Y), "date", "unit", "y", "2024-01-31", 10, fixed_effects=False)
    grid = spark.createDataFrame([("u0", s, float(t)) for s, t in enumerate(np.linspace(-80, 80, 70))], "treated string, step int, theta double")
    got = {x.step: x.p_value for x in synth.refit_tests(panel, p0, p1, grid, "Positive", fixed_effects=False, buckets=3).collect()}
    assert len(got) == 70
    D, post = Y[1:], (np.arange(40) >= p0).astype(float)
    differ = 0
    for x in grid.collect():
        own = Y[0] - x.theta * post
        u = own - simplex_ls(D @ D.T, D @ own) @ D
        sums = np.array([u[(np.arange(p0, 40) + s) % 40].sum() for s in range(40)])
        differ += abs(got[x.step] - (sums >= sums[0] - 1e-9).mean()) > 1e-9
    assert differ <= 2  # a crossing may fall on either side of the solver's tolerance


def test_refit_takes_plain_weights_only(spark):
    Y, Z = series(n=3)
    for more in ({"model": "ridge"}, {"covariates": ["x"]}):
        with pytest.raises(ValueError, match="refit"):
            synth.synth_impact(frame(spark, Y, Z), "date", "unit", "y", ["u0"], "2024-01-31", refit=True, **more)


def test_interval_has_no_end_where_the_grid_has(spark):
    cells = [("a", -1, 0.0, 0.5, 4), ("a", 0, -1.0, 0.5, 4), ("a", 1, 0.0, 0.5, 4), ("a", 2, 1.0, 0.05, 4), ("b", -1, 0.0, 0.05, 4), ("b", 0, 1.0, 0.05, 4), ("b", 1, 2.0, 0.05, 4)]
    got = {r.unit: r for r in synth.refit_interval(spark.createDataFrame(cells, "unit string, step int, theta double, p_value double, n_shifts long"), 0.1).collect()}
    assert (got["a"].ate_lower, got["a"].ate_upper, got["a"].p_value) == (None, 0.0, 0.5)
    assert (got["b"].ate_lower, got["b"].ate_upper, got["b"].p_value) == (None, None, 0.05)


def test_weights_by_entering_donors(spark):
    rng = np.random.default_rng(8)
    n = 300
    Y = rng.random((n, 3)) @ np.cumsum(rng.normal(size=(3, 40)), axis=1) + 0.3 * rng.normal(size=(n, 40))
    panel, p0, _, _ = synth.prepare_panel(frame(spark, Y), "date", "unit", "y", "2024-01-31", 10)
    before = panel.filter(F.col("idx") < p0).checkpoint()
    rows = synth.column_weights(before, ["u0", "u7"], at_once=8).collect()
    Yd = demeaned(Y)[:, :P0]
    for j in (0, 7):
        mine = {int(r.donor[1:]): r for r in rows if r.treated == f"u{j}"}
        w = np.zeros(n)
        w[list(mine)] = [r.weight for r in mine.values()]
        gradient = Yd @ (w @ Yd - Yd[j])
        size = Yd[j] @ Yd[j]
        assert abs(w.sum() - 1) < 1e-9 and w[j] == 0 and len(mine) < 60
        assert np.delete(gradient, j).min() > w @ gradient - 1e-6 * size  # the optimum over all donors
        dense = simplex_ls(np.delete(Yd, j, 0) @ np.delete(Yd, j, 0).T, np.delete(Yd, j, 0) @ Yd[j], tol=1e-15)
        best = np.linalg.norm(dense @ np.delete(Yd, j, 0) - Yd[j])
        r = next(iter(mine.values()))
        assert abs(r.l2_imbalance - np.linalg.norm(w @ Yd - Yd[j])) < 1e-8 and r.l2_imbalance < best + 1e-4 * np.sqrt(size)
        even = np.linalg.norm(np.delete(Yd, j, 0).mean(axis=0) - Yd[j])
        assert abs(r.scaled_l2_imbalance - r.l2_imbalance / even) < 1e-8


def test_entering_donors_without_donors_or_rows(spark):
    one = frame(spark, series(n=1)[0]).withColumn("y_fit", F.col("y"))
    assert synth.column_weights(one, ["u0"]).collect() == [] and synth.column_weights(one.filter("false"), None).collect() == []
    with pytest.raises(ValueError, match="by_columns"):
        synth.synth_impact(one, "date", "unit", "y", ["u0"], "2024-01-31", model="ridge", by_columns=True)
