"""Forests from cell sums: trees against a plain recursion, learners and the causal forest against planted effects."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import forest, observational as O
from conftest import normal_cols, unif


def plain_tree(values, n, a, b, least=0.0):
    """Leaf of each cell by recursion over nodes, features and cuts."""
    leaf = np.full(len(n), -1)

    def split(idx, number=[0]):  # noqa: B006
        effect = b[idx].sum() / a[idx].sum() if a[idx].sum() > 0 else 0.0
        r = b - effect * a
        there, best = idx[n[idx] > 0], None
        if len(there) and (np.abs(r[there]) > 1e-9 * np.abs(b[there]).sum()).any():
            slack = 1e-10 * (r[there] ** 2 / n[there]).sum()
            for j in range(values.shape[1]):
                seen = np.unique(values[there, j])
                for lo, hi in zip(seen[:-1], seen[1:], strict=True):
                    left, right = there[values[there, j] <= lo], there[values[there, j] > lo]
                    if min(n[left].sum(), n[right].sum()) >= least:
                        gain = r[left].sum() ** 2 / n[left].sum() + r[right].sum() ** 2 / n[right].sum()
                        if best is None or gain > best[0] + slack:
                            best = gain, j, lo + (hi - lo) / 2
        if best is None:
            leaf[idx] = number[0]
            number[0] += 1
        else:
            go = values[idx, best[1]] <= best[2]
            split(idx[go], number)
            split(idx[~go], number)

    split(np.arange(len(n)), [0])
    return leaf


@pytest.mark.parametrize("seed", range(60))
def test_tree_equals_the_recursion(seed):
    rng = np.random.default_rng(seed)
    values = np.unique(rng.integers(0, [6, 4, 3], (rng.integers(1, 40), 3)).astype(float), axis=0)
    n = rng.poisson(1.0, len(values)).astype(float)
    b, least = n * rng.normal(size=len(n)), float(seed % 3)
    got, importance = forest.grow(values, n, n, b, least=least)
    want = plain_tree(values, n, n, b, least)
    assert np.allclose(forest.leaf_means(got, n, b), forest.leaf_means(want, n, b), equal_nan=True)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want)) and (importance >= 0).all()


def test_full_tree_has_the_cell_means():
    rng = np.random.default_rng(1)
    values = np.array([(i, j) for i in range(12) for j in range(5)], float)
    n = rng.integers(1, 9, 60).astype(float)
    mean = rng.normal(size=60)
    leaf, _ = forest.grow(values, n, n, n * mean)
    assert np.allclose(forest.leaf_means(leaf, n, n * mean), mean)


def test_other_half_keeps_its_least_share():
    rng = np.random.default_rng(2)
    values = np.array([(i,) for i in range(200)], float)
    n, other = rng.poisson(3.0, 200).astype(float), rng.poisson(3.0, 200).astype(float)
    leaf, _ = forest.grow(values, n, n, n * rng.normal(size=200), least=5.0, least_share=0.05, other_n=other)
    assert np.bincount(leaf, n).min() >= 5 and np.bincount(leaf, other).min() >= 5


def test_tried_features_are_drawn_among_those_that_can_be_cut():
    values = np.column_stack([np.zeros(8), np.arange(8.0), np.ones(8)])
    n, y = np.ones(8), np.arange(8.0)
    leaf, importance = forest.grow(values, n, n, y, 1, np.random.default_rng(0))
    assert len(set(leaf)) == 8 and importance[0] == importance[2] == 0


def test_no_depth_limit():
    for operator in (O.t_learner_rf, O.s_learner_rf, O.linear_dml, O.causal_forest):
        assert "depth" not in inspect.signature(operator).parameters
    values = np.arange(300.0)[:, None]
    leaf, _ = forest.grow(values, np.ones(300), np.ones(300), 2.0 ** -np.arange(300.0))  # every cut takes off one cell
    assert len(set(leaf)) > 20


def stepped(spark, n=6000, noise=1.0):
    """Effect 1 below x = 5 and 5 from there on; treatment and outcome both depend on z."""
    d = spark.range(n).select("id", F.floor(unif(F, "id", 1, "x") * 10).alias("x"), F.floor(unif(F, "id", 1, "z") * 4).alias("z"), unif(F, "id", 1, "t").alias("u"),
                              normal_cols(F, "id", 1, "e").alias("e"))
    d = d.withColumn("t", (F.col("u") < 0.3 + 0.1 * F.col("z")).cast("int"))
    effect = F.when(F.col("x") >= 5, 5.0).otherwise(1.0)
    return d.withColumn("truth", effect).withColumn("y", 3 * F.col("z") + effect * F.col("t") + noise * F.col("e"))


def by_truth(scored):
    return {r.truth: r for r in scored.groupBy("truth").agg(F.avg("Estimated_ITE").alias("ite"), F.count("Estimated_ITE").alias("n")).collect()}


def test_learners_find_a_step(spark):
    d = stepped(spark)
    for fn in (O.t_learner_rf, O.s_learner_rf):
        got = by_truth(fn(d, "t", "y", ["x", "z"], trees=20, row_id="id"))
        assert abs(got[1.0].ite - 1) < 0.25 and abs(got[5.0].ite - 5) < 0.25 and got[1.0].n + got[5.0].n == 6000, fn


def test_binary_outcomes_and_rows_without_ids(spark):
    d = stepped(spark, 3000).withColumn("y", (unif(F, "id", 9, "b") < 0.2 + 0.1 * F.col("truth") * F.col("t")).cast("int"))
    got = by_truth(O.t_learner_rf(d, "t", "y", ["x", "z"], binary=True, trees=20))
    assert abs(got[1.0].ite - 0.1) < 0.08 and abs(got[5.0].ite - 0.5) < 0.08


def test_forest_dml_removes_confounding(spark):
    r = O.linear_dml(stepped(spark), "t", "y", ["x", "z"], "id", nuisance="rf", modifiers=[], trees=20).first()
    naive = stepped(spark).groupBy("t").agg(F.avg("y").alias("m")).orderBy("t").collect()
    assert abs(r.estimate - 3.0) < 0.2 and abs(naive[1].m - naive[0].m - 3.0) > 0.5 and 0 < r.std_error < 0.2


def test_causal_forest_recovers_a_step_and_covers_it(spark):
    d = stepped(spark)
    scored, importances = O.causal_forest(d, "t", "y", ["x", "z"], "id", trees=200)
    got = by_truth(scored)
    assert abs(got[1.0].ite - 1) < 0.3 and abs(got[5.0].ite - 5) < 0.3
    z = 1.959964
    cells = scored.groupBy("x", "z", "truth").agg(F.first("Estimated_ITE").alias("m"), F.first("Estimated_ITE_se").alias("s")).collect()
    inside = [abs(c.m - c.truth) <= z * c.s for c in cells if c.x not in (4, 5)]  # at the step itself leaves mix both sides
    assert all(c.s > 0 for c in cells) and sum(inside) >= 0.8 * len(inside)
    rank = {r.feature: r.importance for r in importances.collect()}
    assert rank["x"] > 0.7 and abs(sum(rank.values()) - 1) < 1e-9
    ate = O.causal_ate(scored).first()
    assert ate.ci_lower < 3.0 < ate.ci_upper and ate.n == 6000


def test_many_values_are_cut_at_quantiles_and_nulls_are_large(spark):
    d = stepped(spark, 4000).withColumn("v", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("x") + unif(F, "id", 3, "v") * 0.99))
    cells, xs = forest.with_cells(d, ["v", "z"], bins=20)
    seen = {r._x0: (r.lo, r.hi, r.n) for r in cells.groupBy("_x0").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).collect()}
    assert len(seen) == 21 and seen[float("inf")] == (None, None, 400) and xs == ["_x0", "_x1"]
    order = sorted(k for k in seen if k != float("inf"))
    assert all(seen[a][1] < seen[b][0] for a, b in zip(order, order[1:], strict=False)) and all(100 < seen[k][2] < 260 for k in order)
    got = by_truth(O.t_learner_rf(d, "t", "y", ["v", "z"], trees=20, row_id="id", bins=20).filter("v IS NOT NULL"))
    assert abs(got[1.0].ite - 1) < 0.4 and abs(got[5.0].ite - 5) < 0.4


def test_empty_arm_and_empty_table(spark):
    d = stepped(spark, 50).withColumn("t", F.lit(1))
    assert O.t_learner_rf(d, "t", "y", ["x"], trees=4, row_id="id").filter("Estimated_ITE IS NOT NULL").count() == 0
    assert O.s_learner_rf(d.limit(0), "t", "y", ["x"], trees=4, row_id="id").count() == 0
