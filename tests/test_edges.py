"""Edge fixtures listed in FIXTURES.md (each pins a rule of SURVEY 1.3 / 3.4)."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.operators import clean as C
from causeway.operators import observational as O
from causeway.operators import panel as TS
from causeway.operators.regression import logit_effect, ols_effect


def test_constant_column_cut_matches_pandas(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(6)], "id int, x double")
    got = [r["x_b"] for r in C.bucket_equal_width(df, "x", 3, "x_b").orderBy("id").collect()]
    exp = [str(v) for v in pd.cut(pd.Series([5.0] * 6), bins=3, precision=1)]
    assert got == exp


def test_cut_small_values_labels_match_pandas(spark):
    vals = [-0.004, 0.3, 1.2, 2.5, 0.0, 1.9]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, x double")
    got = [r["b"] for r in C.bucket_equal_width(df, "x", 4, "b").orderBy("id").collect()]
    assert got == [str(v) for v in pd.cut(pd.Series(vals), bins=4, precision=1)]


def test_log_skips_negative_column(spark):
    df = spark.createDataFrame([(1.0, -1.0), (3.0, 2.0)], "a double, b double")
    out = C.log_transform(df, ["a", "b"]).collect()
    assert abs(out[0]["a"] - 0.6931471805599453) < 1e-15 and out[0]["b"] == -1.0


def test_all_null_numeric_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, n double")
    out = C.impute_numeric(df, ["n"], "Mean").collect()
    assert all(r["n"] is None for r in out)


def test_treated_unit_missing_and_intervention_range(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 1.0), ("a", "2024-01-05", 2.0)], "u string, d string, y double") \
        .withColumn("d", F.to_date("d"))
    with pytest.raises(TS.PanelError):
        TS.unit_series(df, "d", "u", "zzz", "y")
    with pytest.raises(TS.PanelError):
        TS.split_pre_post(df, "d", "2024-02-01")
    with pytest.raises(TS.PanelError):
        TS.panel_pivot(df, "d", "u", "y", treated="zzz")


def test_perfect_separation_reports_error(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.0), (1, 1.0), (1, 1.0)] * 5, "t int, y double")
    row = logit_effect(df, "t", "y").collect()[0]
    assert row["error"] is not None and "separation" in row["error"].lower()


def test_collinear_confounder_min_norm(spark):
    df = spark.range(200).select((F.col("id") % 2).cast("int").alias("t"), F.col("id").cast("double").alias("x"))
    df = df.select("*", (2 * F.col("x")).alias("x2"), (3 * F.col("t") + F.col("x")).alias("y"))
    row = ols_effect(df, "t", "y", ["x", "x2"]).collect()[0]
    assert abs(row["estimate"] - 3.0) < 1e-6


def test_cell_with_one_arm_is_reported(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 0, 0.0), (1, 1, 5.0)] * 4, "cell int, t int, y double")
    row = O.standardization(df, "t", "y", ["cell"]).collect()[0]
    assert row["cells_without_overlap"] == 1 and row["rows_without_overlap"] == 4
    assert abs(row["estimate"] - 1.0) < 1e-12
    assert O.positivity_report(df, "t", ["cell"]).count() == 1


def test_degenerate_inputs_give_nulls_not_errors(spark):
    """Spark 4 runs with ANSI division: degenerate groups must yield nulls, not exceptions."""
    from causeway.operators import archive
    from causeway.operators import profile as P
    df = spark.createDataFrame([(1, 5.0, 1.0), (0, 3.0, 1.0), (0, 4.0, 1.0)], "t int, y double, z double")
    w = O.welch_table(df, "t", ["y"]).collect()[0]
    assert w["dof"] is None or w["dof"] != w["dof"] or w["t_stat"] is None
    assert archive.wald_iv(df, "z", "t", "y").collect()[0]["estimate"] is None
    empty = df.filter(F.col("t") > 5)
    assert all(r["percent"] is None for r in P.missing_report(empty).collect())
