"""One dispatcher for periods, replicates and refutations: every method against planted effects and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import archive, cells, effects, observational as O, refute, regression, synth
from causeway.operators.permute import permuted
from conftest import normal_cols, unif


@pytest.fixture(scope="module")
def panel(spark):
    """Effect 2 in period a, 4 in b; c has one arm only, d too few rows; x confounds."""
    d = spark.range(3000).select("id", F.when(F.col("id") < 1400, "a").when(F.col("id") < 2800, "b").when(F.col("id") < 2990, "c").otherwise("d").alias("p"),
                                 F.floor(unif(F, "id", 1, "x") * 3).alias("x"), unif(F, "id", 1, "t").alias("u"), normal_cols(F, "id", 1, "e").alias("e"))
    d = d.withColumn("t", F.when(F.col("p") == "c", 1).otherwise((F.col("u") < 0.3 + 0.2 * F.col("x")).cast("int")))
    truth = F.when(F.col("p") == "b", 4.0).otherwise(2.0)
    return d.withColumn("y", 3 * F.col("x") + truth * F.col("t") + 0.5 * F.col("e")).cache()


@pytest.mark.parametrize("method", effects.METHODS)
def test_every_method_by_period(panel, method):
    options = {"trees": 20} if method in effects.FORESTS else {}
    got = {r.p: r for r in effects.by_period(panel, method, "t", "y", ["x"], "p", "id", **options).collect()}
    tolerance = 0.6 if method.startswith("psm") else 0.25
    assert set(got) == {"a", "b", "c"} and abs(got["a"].ATE - 2) < tolerance and abs(got["b"].ATE - 4) < tolerance
    assert got["c"].ATE is None and got["c"].n == 190 and got["a"].n == 1400


@pytest.mark.parametrize("method", ["ols", "iptw", "psm", "dml_cells"])
def test_bootstrap_of_every_method(panel, method):
    b = effects.bootstrap(panel.filter("p = 'a'"), method, "t", "y", ["x"], "id", replicates=12).first()
    assert abs(b.estimate - 2) < 0.6 and b.ci_lower < b.boot_mean < b.ci_upper and b.replicates_ok == 12 and 0 < b.boot_se < 0.5


def test_bootstrap_of_forests(panel):
    b = effects.bootstrap(panel.filter("p = 'a'"), "t_learner", "t", "y", ["x"], "id", replicates=10, trees=10).first()
    assert abs(b.estimate - 2) < 0.3 and b.replicates_ok == 10


@pytest.mark.parametrize("method, refuter", [("iptw", "random_common_cause"), ("iptw", "placebo"), ("psm_cells", "placebo"), ("dml_cells", "random_common_cause"), ("t_learner", "placebo")])
def test_refutation_of_the_chosen_method(panel, method, refuter):
    options = {"trees": 10} if method in effects.FORESTS else {}
    r = refute.refute_effect(panel.filter("p = 'b'"), "t", "y", ["x"], "id", method=method, refuter=refuter, replicates=8, **options).first()
    assert r.error is None and abs(r.original_effect - 4) < 0.6
    assert abs(r.new_effect - (4 if refuter == "random_common_cause" else 0)) < 0.6


def test_weights_count_as_repeated_rows(panel):
    d = panel.filter("p <> 'd'").withColumn("_w", F.col("id") % 3)
    copies = d.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest("_w", F.lit(1))))).filter("k <= _w")
    for method in ("ols", "iptw", "psm", "iptw_cells", "psm_cells", "g_formula"):
        rows, xs = effects.rows_of(d, method, "t", "y", ["x"], "id", ["p", "_w"])
        a = {r.p: r for r in effects.effects(rows, method, xs, ["p"], weight="_w").collect()}
        rows, xs = effects.rows_of(copies, method, "t", "y", ["x"], "id", ["p"])
        b = {r.p: r for r in effects.effects(rows, method, xs, ["p"]).collect()}
        assert all(a[p].n == b[p].n and abs(a[p].estimate - b[p].estimate) < 1e-8 for p in ("a", "b")), method
        if a["a"].std_error is not None and method != "ols":
            assert abs(a["a"].std_error - b["a"].std_error) < 1e-8, method


def test_logit_by_key_in_both_ways_equals_single_fits(panel):
    d = panel.filter("p IN ('a', 'b')").withColumn("z", F.col("e"))
    for xs, discrete, in_task in ((["x"], True, None), (["x"], True, 0), (["x"], False, None), (["x", "z"], None, None)):
        got = {r.p: r for r in regression.logit_by_key(d, "t", xs, ["p"], discrete=discrete, in_task=in_task).collect()}
        for p in "ab":
            want = regression.logit_fit(d.filter(F.col("p") == p), "t", xs)
            assert got[p].error is None and got[p].n == 1400 and np.allclose(got[p].beta, want["beta"], atol=1e-7)


def test_logit_by_key_names_what_failed(spark):
    rows = [("sep", float(i), int(i >= 5)) for i in range(10)] + [("one", float(i), 1) for i in range(10)] + [("ok", float(i % 2), i % 3 % 2) for i in range(30)]
    d = spark.createDataFrame(rows, "p string, x double, t int")
    for in_task in (None, 0):
        got = {r.p: r.error for r in regression.logit_by_key(d, "t", ["x"], ["p"], discrete=True, in_task=in_task).collect()}
        assert got["ok"] is None and got["sep"] and got["one"]


def test_a_permutation_keeps_every_value_in_every_replicate(spark):
    d = spark.range(400).select("id", F.when(F.col("id") % 10 == 0, 2.0).when(F.col("id") % 7 == 0, 1.0).otherwise(0.0).alias("t")).repartition(5)
    want = sorted((r.t, r["count"]) for r in d.groupBy("t").count().collect())
    for most in (64, 2):
        from causeway.operators import permute
        permute.MOST_VALUES, kept = most, permute.MOST_VALUES
        try:
            got = permuted(d, "t", "id", 6, 42).groupBy("_rep", "_placebo").count().collect()
        finally:
            permute.MOST_VALUES = kept
        for k in range(1, 7):
            assert sorted((r._placebo, r["count"]) for r in got if r._rep == k) == want


@pytest.mark.parametrize("ids", [600, 40, 1])
def test_cuts_of_a_permutation(spark, ids):
    """The cuts are the rows of the ranks asked for by (key, id), also where ids repeat and the keys are bunched."""
    from causeway.functions.columns import explode_replicates, row_seed
    from causeway.operators import permute
    base = spark.range(600).select((F.col("id") % ids).alias("id")).repartition(3)
    rep = explode_replicates(base, row_seed(F.col("id"), F.lit(7)), 5, 3).select("_rep", "id", "_u1")
    rows = {k: sorted(zip(g["_u1"], g["id"], strict=True)) for k, g in rep.toPandas().groupby("_rep")}
    for ranks in ([120], [3, 5, 300, 599], [600]):
        got = {r["_rep"]: [(c["u"], c["id"]) for c in r["_cuts"]] for r in permute._cuts(rep, "id", ranks, 600, 5).collect()}
        assert got == {k: [v[r - 1] for r in ranks] for k, v in rows.items()}


def test_brackets_of_a_permutation_hold_few_rows(spark, monkeypatch):
    """Nothing but the counts and the rows near a cut is kept: about the root of all rows."""
    from causeway.operators import permute
    kept = []
    monkeypatch.setattr(permute, "written", lambda df, name: kept.append(df.count()) or df)
    d = spark.range(40_000).select("id", (F.col("id") % 5 == 0).cast("double").alias("t"))
    assert permuted(d, "t", "id", 4, 42).groupBy("_rep").agg(F.sum("_placebo").alias("s")).select("s").distinct().first().s == 8_000
    assert len(kept) == 1 and kept[0] < 4 * 20 * 200


def test_custom_estimators_see_a_permuted_treatment(spark, panel):
    """Three values: none vanishes from the placebo; replicates without an estimate are left out."""
    d = panel.filter("p = 'a'").withColumn("t", (F.col("id") % 3).cast("int"))
    seen = []

    def slope(f, t, y, xs):
        seen.append(sorted(r[t] for r in f.select(t).distinct().collect()))
        return f.agg((F.regr_slope(y, t) if len(seen) != 3 else F.max(F.lit(None).cast("double"))).alias("estimate"))
    per, s = refute.re_estimated(d, "t", "y", ["x"], "id", slope, "placebo", 4, 42)
    assert all(v == [0, 1, 2] for v in seen) and per.count() == 3 and abs(s.first().new_effect) < 0.3


# Two-way fixed effects ------------------------------------------------------------------------------

def test_twoway_effects_on_unbalanced_panels(spark):
    rng = np.random.default_rng(0)
    rows = []
    for u in range(40):
        for t in range(12):
            if rng.random() < 0.6:
                x = rng.normal() + 0.1 * u + 0.3 * t
                rows.append((f"u{u}", t, float(x), float(2 * x + 5 * u - 3 * t * t)))
    d = spark.createDataFrame(rows, "u string, t int, x double, y double").repartition(4)
    r = archive.twoway_fixed_effects(d, "u", "t", "y", "x").first()
    assert abs(r.estimate - 2) < 1e-8 and r.clusters == 40


def test_twoway_effects_equal_dummies_and_drop_singletons(spark):
    rng = np.random.default_rng(1)
    rows = [(f"u{u}", t, float(rng.normal() + u % 3), 0.0) for u in range(15) for t in range(6) if rng.random() < 0.7 for _ in range(1 + (u + t) % 2)]
    rows = [(u, t, x, float(1.5 * x + len(u) * t + rng.normal())) for u, t, x, _ in rows]
    part = [(f"v{u}", 100 + t, float(rng.normal()), float(rng.normal())) for u in range(4) for t in range(3)]  # shares nothing with the rest
    alone = [("single", 3, 9.0, 77.0), ("u1", 55, 4.0, -50.0)]
    d = spark.createDataFrame(rows + part + alone, "u string, t int, x double, y double").repartition(3)
    kept = rows + part
    us, ts = sorted({r[0] for r in kept}), sorted({r[1] for r in kept})
    X = np.array([[r[2], *[r[0] == u for u in us], *[r[1] == t for t in ts]] for r in kept], float)
    want = np.linalg.lstsq(X, np.array([r[3] for r in kept]), rcond=None)[0][0]
    r = archive.twoway_fixed_effects(d, "u", "t", "y", "x").first()
    assert abs(r.estimate - want) < 1e-7 and r.clusters == len(us) and r.std_error > 0
    flat = archive.twoway_fixed_effects(d.withColumn("x", F.col("t").cast("double")), "u", "t", "y", "x").first()
    assert flat.estimate is None and flat.std_error is None


# Intervals ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("stat", ["Total", "Positive", "Negative"])
@pytest.mark.parametrize("alpha", [0.02, 0.1, 0.25])
def test_inverted_interval_against_a_fine_grid(spark, stat, alpha):
    rng = np.random.default_rng(4)
    u, p0, length = rng.normal(size=30), 22, 6
    u[22:28] += 1.5
    T = len(u)
    post = np.zeros(T, bool)
    post[p0:p0 + length] = True
    A = [u[(np.flatnonzero(post) + s) % T].sum() for s in range(T)]
    c = [post[(np.flatnonzero(post) + s) % T].sum() for s in range(T)]
    s = spark.createDataFrame([("x", k, float(A[k]), int(c[k])) for k in range(T)], "unit string, shift int, A double, c int")
    r = synth.effect_interval(s, alpha, stat).first()
    theta = np.linspace(-40, 40, 160_001)
    value = {"Total": np.abs, "Positive": np.positive, "Negative": np.negative}[stat](np.array(A)[:, None] - theta * np.array(c)[:, None])
    kept = theta[(value >= value[0] - 1e-12).sum(axis=0) >= alpha * T - 1e-9]
    lo, hi = kept.min(), kept.max()
    assert (r.ate_lower is None) == (lo < -39.9) and (r.ate_upper is None) == (hi > 39.9)
    assert r.ate_lower is None or abs(r.ate_lower - lo) < 1e-3
    assert r.ate_upper is None or abs(r.ate_upper - hi) < 1e-3


def test_many_cells_are_in_no_single_task(spark):
    d = spark.range(100_000).select("id", F.col("id").alias("cell"), (F.col("id") % 2).cast("int").alias("t"), F.col("id").cast("double").alias("y"))
    for df in (cells.iptw_cells(d, "t", "y", ["cell"]), cells.iptw_cells(d, "t", "y", ["cell"], normalized=True),
               cells.t_learner_cells(d, "t", "y", ["cell"]), cells.dml_cells(d, "t", "y", ["cell"], "id")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        windows = [i for i, line in enumerate(plan.splitlines()) if "Window [" in line]
        lines = plan.splitlines()
        assert not any("SinglePartition" in line for i in windows for line in lines[i:i + 3]), plan
        assert "Cartesian" not in plan and "NestedLoop" not in plan
