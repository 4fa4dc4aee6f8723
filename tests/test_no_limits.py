"""Statistics stay exact beyond any size, and earlier wrong answers stay mended."""

import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from causeway.functions.columns import exact_quantiles, grouped_quantiles
from causeway.operators import cells, clean, observational as O, panel, profile, refute, synth
from causeway.plans.views import v1_lineitem

from conftest import SF_SMOKE, normal_cols, unif


def test_exact_quantiles_of_many_distinct_values(spark):
    n = 5_200_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("x"), F.lit(3.0).alias("c"), F.lit(None).cast("double").alias("e"))
    q = exact_quantiles(df, ["x", "c", "e"], [0.0, 0.05, 0.5, 0.999, 1.0])
    assert q["x"] == [p * (n - 1) for p in (0.0, 0.05, 0.5, 0.999, 1.0)] or np.allclose(q["x"], [p * (n - 1) for p in (0.0, 0.05, 0.5, 0.999, 1.0)], rtol=0, atol=1e-6)
    assert q["c"] == [3.0] * 5 and q["e"] == [None] * 5


def test_exact_quantiles_with_ties_and_skew(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([np.zeros(30_000), rng.integers(0, 5, 30_000), rng.lognormal(0, 3, 40_001)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0.01, 0.25, 0.3, 0.5, 0.75, 0.9, 0.99]
    assert np.allclose(exact_quantiles(df, ["x"], probs)["x"], np.quantile(x, probs), rtol=1e-12)


def test_exact_quantiles_between_two_frequent_values(spark):
    """The ranks asked for are the last row of one value and the first of the next: no bracket of them is narrower than both values."""
    done = threading.Event()

    def stop():  # instead of passes without an end
        while not done.wait(1):
            spark.sparkContext.cancelAllJobs()
    timer = threading.Timer(90, stop)
    timer.start()
    try:
        df = spark.range(40_000, numPartitions=3).select((F.col("id") % 2).cast("double").alias("x"), F.floor(F.col("id") / 10_000).alias("y"))
        q = exact_quantiles(df, ["x", "y"], [0.25, 0.5, 0.75])
    finally:
        timer.cancel()
        done.set()
    assert q == {"x": [0.0, 0.5, 1.0], "y": [0.75, 1.5, 2.25]}


def test_grouped_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g, n in (("a", 5000), ("b", 7), ("c", 1), (None, 40)) for v in rng.integers(0, 900, n)]
    df = spark.createDataFrame(rows + [("a", None), ("d", None)], "g string, v double").repartition(6)
    got = {r.g: r.q for r in grouped_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9]).collect()}
    for g in ("a", "b", "c", None):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g], [0.1, 0.5, 0.9]))
    assert "d" not in got


def test_distinct_counts_and_dummies_have_no_limit(spark):
    df = spark.range(1_050_000).select("id", (F.col("id") % 130).cast("string").alias("kind"))
    n = {r["column_name"]: r["nunique"] for r in profile.nunique(df).collect()}
    assert n == {"id": 1_050_000, "kind": 130}
    labels = {r["column_name"]: r["label"] for r in profile.eligibility(df).collect()}
    assert labels["id"] == "Numeric, 1050000 unique"
    assert len(clean.one_hot(df.limit(500), ["kind"]).columns) == 130


def test_balancing_needs_two_classes(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, t int")
    for fn in (clean.oversample_minority, clean.downsample_majority):
        with pytest.raises(ValueError):
            fn(df, "t", "id")


def test_filters_reach_the_scan(spark):
    o = spark.read.parquet(f"{SF_SMOKE}/orders.parquet")
    plan = clean.apply_filter(o, "o_totalprice", ">", 30000.0)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,30000.0)" in plan


def test_missing_label_leaves_dates_alone(spark):
    df = spark.createDataFrame([("a", None), (None, None)], "s string, d date")
    assert [tuple(r) for r in clean.impute_categorical(df, method="Missing").collect()] == [("a", None), ("Missing", None)]


def _effect(spark, truth, n=3000):
    df = spark.range(n).select("id", (unif(F, "id", 5, "t") < 0.4).cast("int").alias("t"), normal_cols(F, "id", 5, "y").alias("e"))
    return df.withColumn("y", F.col("e") + truth * F.col("t"))


def test_placebo_passes_a_real_effect(spark):
    _, s = refute.placebo_treatment(_effect(spark, 5.0), "t", "y", [], "id", replicates=40)
    r = s.first()
    assert abs(r.new_effect) < 0.1 and r.passed and r.p_value > 0.05


def test_placebo_of_other_codings(spark):
    df = _effect(spark, 5.0).withColumn("t2", F.col("t") * 2)
    per, s = refute.placebo_treatment(df, "t2", "y", [], "id", replicates=20)
    assert s.first().new_sd > 0 and len({round(r.estimate, 9) for r in per.collect()}) == 20
    many = df.withColumn("t3", (F.col("id") % 5).cast("double"))
    per, s = refute.placebo_treatment(many, "t3", "y", [], "id", replicates=10)
    assert s.first().new_sd > 0 and per.count() == 10


def test_placebo_is_a_permutation_at_every_size(spark):
    df = _effect(spark, 1.0, 500).repartition(7)
    a = sorted((r.rep, round(r.estimate, 9)) for r in refute.placebo_treatment(df, "t", "y", [], "id", replicates=5)[0].collect())
    rows = df.toPandas()
    from causeway.functions.columns import explode_replicates, row_seed
    rep = explode_replicates(df.select("id", "t", "y"), row_seed(F.col("id"), F.lit(42)), 5, 3).toPandas()
    n1 = int(rows.t.sum())
    want = []
    for k, g in rep.groupby("_rep"):
        g = g.sort_values(["_u1", "id"])
        want.append((k, round(g.y[:n1].mean() - g.y[n1:].mean(), 9)))
    assert np.allclose([e for _, e in a], [e for _, e in sorted(want)], atol=1e-7)


def test_dispatcher_runs_the_named_method_or_says_so(spark):
    df = _effect(spark, 5.0, 800)
    r = refute.refute_effect(df, "t", "y", [], "id", method="LinearDML", refuter="placebo", replicates=5).first()
    assert r.error and r.original_effect is None

    def iptw(d, t, y, xs):
        return cells.iptw_cells(d, t, y, [c for c in xs if c != "_rcc"])
    r = refute.refute_effect(df.withColumn("g", F.col("id") % 3), "t", "y", ["g"], "id", method="IPTW", refuter="placebo", replicates=16, estimator=iptw).first()
    assert r.error is None and abs(r.original_effect - 5) < 0.3 and abs(r.new_effect) < 0.3 and r.passed


def test_hajek_error_is_that_of_the_difference(spark):
    df = _effect(spark, 2.0, 4000).withColumn("y", F.col("y") + 1000).withColumn("propensity", F.lit(0.4))
    r = O.iptw(df, "t", "y", normalized=True).first()
    p = df.toPandas()
    se = math.sqrt(p.y[p.t == 1].var() / (p.t == 1).sum() + p.y[p.t == 0].var() / (p.t == 0).sum())
    assert abs(r.std_error / se - 1) < 0.05
    c = cells.iptw_cells(df.withColumn("g", F.lit(1)), "t", "y", ["g"], normalized=True).first()
    assert abs(c.std_error / se - 1) < 0.05


def test_rows_with_null_confounders_stay(spark):
    df = _effect(spark, 1.0, 3000).withColumn("g", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2))
    assert O.with_propensity(df, "t", ["g"]).filter("propensity IS NOT NULL").count() == 3000
    assert cells.iptw_cells(df, "t", "y", ["g"]).first().n == 3000
    assert O.t_learner_saturated(df, "t", "y", ["g"]).filter("Estimated_ITE IS NOT NULL").count() == 3000
    assert cells.dml_cells(df, "t", "y", ["g"], "id").first().n == 3000


def test_rows_without_overlap_are_reported(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (0, 2.0, 0.5), (1, 3.0, 0.5), (0, 1.0, 0.5), (1, 4.0, 0.5)], "t int, y double, propensity double")
    assert "1 rows without overlap" in O.iptw(df, "t", "y").first().error


def test_scan_counts_of_the_cell_estimators(spark):
    li = v1_lineitem(spark, SF_SMOKE).withColumn("rid", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    for df in (cells.iptw_cells(li, "treated", "l_extendedprice", ["l_linestatus"]), cells.dml_cells(li, "treated", "l_extendedprice", ["l_linestatus"], "rid"),
               cells.t_learner_cells(li, "treated", "l_extendedprice", ["l_linestatus"]), cells.propensity_cells(li, "treated", ["l_linestatus"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert sum("lineitem" in line for line in plan.splitlines() if "FileScan" in line) <= 1, plan  # cells are written after one scan


def test_nearest_scores_against_a_search(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), float(round(s, 2)), float(y)) for a, s, y in zip(rng.integers(0, 2, 300), rng.random(300), rng.normal(size=300), strict=True)]
    c = O.score_cells(spark.createDataFrame(rows, "t int, y0 double, y double").withColumnRenamed("y0", "propensity"), "t", "y").repartition(8)
    got = {(r.arm, r.score): r.matched_y for r in O.nearest_scores(c).collect()}
    held = {(r.arm, r.score): r.mean_y for r in c.collect()}
    for (arm, s), m in got.items():
        other = sorted((abs(s - x), x) for a, x in held if a != arm)
        assert m == held[1 - arm, other[0][1]]
    one = spark.createDataFrame([(1, 0.3, 2.0)], "t int, propensity double, y double")
    assert O.psm(one, "t", "y").filter("estimand = 'ATE'").first().estimate is None


def test_panel_grid_fills_missing_unit_dates(spark):
    import datetime as dt
    d = [dt.date(2024, 1, k) for k in (1, 2, 4)]
    rows = [("a", x, 1.0 * i, 5.0) for i, x in enumerate(d)] + [("b", d[1], 9.0, None)]
    df = spark.createDataFrame(rows, "u string, d date, y double, c double").withColumn("e", F.lit(None).cast("double"))
    got = sorted(tuple(r) for r in panel.bayes_panel_long(df, "d", "u", "y", ["c", "e"]).collect())
    assert got == [("a", d[0], 0.0, 5.0), ("a", d[1], 1.0, 5.0), ("a", d[2], 2.0, 5.0), ("b", d[0], 9.0, 5.0), ("b", d[1], 9.0, 5.0), ("b", d[2], 9.0, 5.0)]


def test_synthetic_control_drops_units_with_gaps(spark):
    import datetime as dt
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    rows = [(u, x, 100.0 + 3 * (i % 5) + (17.0 if u == "t" and i >= 20 else 0.0)) for u in "tabc" for i, x in enumerate(days) if not (u == "b" and i in (22, 25))]
    r = synth.synth_impact(spark.createDataFrame(rows, "u string, d date, y double"), "d", "u", "y", ["t"], "2024-01-21", 7, with_ci=False)
    assert abs(r["impact"].first().ate - 17.0) < 1e-6
    assert {x.donor for x in r["weights"].collect()} == {"a", "c"}


def test_shared_folder_and_shipping(spark):
    from causeway import session
    assert session._is_local("local[4]") and not session._is_local("spark://host:7077") and not session._is_local("local-cluster[2,1,1024]")
    import zipfile
    names = zipfile.ZipFile(session.ship_package(spark)).namelist()
    assert "causeway/operators/cells.py" in names


def test_queries_hold_no_subsets():
    import pathlib
    text = "".join(p.read_text() for p in (pathlib.Path(E.__file__).parent / "causeway" / "plans").glob("*.py"))
    for cut in ("trees=10", "_R = 20", "value > 99", "grid=50", "grid=100"):
        assert cut not in text
