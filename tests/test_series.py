"""One call for the series of an impact analysis, against plain pandas."""

import datetime as dt

import pandas as pd
import pytest

from causeway.operators import panel

DAY = dt.datetime(2024, 1, 1, 5)
ROWS = [(DAY, "a.b", 1.0, 10.0), (DAY, "a.b", 3.0, None), (DAY, "c", 5.0, 7.0), (DAY + dt.timedelta(days=3), "a.b", None, 2.0), (DAY + dt.timedelta(days=3), "c", 2.0, 1.0),
        (DAY + dt.timedelta(days=4, hours=9), "c", 9.0, 4.0), (None, "c", 100.0, 100.0), (DAY + dt.timedelta(days=1), None, 8.0, 6.0)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "at timestamp_ntz, geo string, y double, x double").repartition(3)


def days(df):
    return [tuple(r)[1:] for r in df.orderBy("at").collect()]


def plain(frame, columns):
    """Daily means, filled forward."""
    d = frame.dropna(subset=["at"]).assign(at=lambda f: pd.to_datetime(f["at"]).dt.normalize())
    s = d.groupby("at")[columns].mean().asfreq("D").ffill()
    return [tuple(None if pd.isna(v) else v for v in r) for r in s.itertuples(index=False)]


def test_means_of_all_rows(rows):
    got = panel.causal_series(rows, "at", "y", covariates=["x"])
    assert got.columns == ["at", "y", "x"] and days(got) == plain(pd.DataFrame(ROWS, columns=["at", "geo", "y", "x"]), ["y", "x"])


def test_one_unit(rows):
    f = pd.DataFrame(ROWS, columns=["at", "geo", "y", "x"])
    got = panel.causal_series(rows, "at", "y", "geo", "a.b", covariates=["x"])
    assert days(got) == plain(f[f["geo"] == "a.b"], ["y", "x"]) == [(2.0, 10.0), (2.0, 10.0), (2.0, 10.0), (2.0, 2.0)]
    with pytest.raises(panel.PanelError):
        panel.causal_series(rows, "at", "y", "geo", "nowhere")


def test_units_beside_each_other(rows):
    got = panel.causal_series(rows, "at", "y", "geo", "c", True, ["x"])
    assert got.columns == ["at", "c", "a.b", "x"]
    assert days(got) == [(5.0, 4.0, 7.0), (5.0, 4.0, 7.0), (5.0, 4.0, 7.0), (2.0, 4.0, 1.0), (9.0, 4.0, 4.0)]
    with pytest.raises(panel.PanelError):
        panel.causal_series(rows, "at", "y", "geo", "nowhere", True)
    with pytest.raises(panel.PanelError, match="name"):
        panel.causal_series(rows.withColumnRenamed("x", "c"), "at", "y", "geo", "c", True, ["c"])


def test_no_rows(rows):
    assert days(panel.causal_series(rows.filter("false"), "at", "y")) == []
