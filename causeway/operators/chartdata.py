"""Aggregations behind the chart builder (AGG1-AGG7); rendering is not built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import NUMERIC

_AGGS = {
    "Mean": F.avg, "Sum": F.sum, "Count": F.count, "Min": F.min, "Max": F.max,
}


def group_aggregate(df: DataFrame, x: str, ys: Sequence[str], how: str = "Mean", color: str | None = None,
                    facet: str | None = None) -> DataFrame:
    """AGG1/AGG3: group by x [+ color] [+ facet] and aggregate every y (null keys dropped, as pandas).
    Medians are exact at every size (``grouped_quantiles``)."""
    keys = [k for k in (facet, x, color) if k]
    rows = _filter_keys(df, keys)
    if how == "Median":
        from ..functions.columns import grouped_quantiles
        out = rows.select(*keys).distinct()
        for y in ys:
            q = grouped_quantiles(rows, keys, y, [0.5], "_q").select(*keys, F.col("_q")[0].alias(y))
            out = out.join(q, keys, "left")
        return out.orderBy(*keys)
    return rows.groupBy(*keys).agg(*[_AGGS[how](F.col(y)).alias(y) for y in ys]).orderBy(*keys)


def _filter_keys(d: DataFrame, keys) -> DataFrame:
    for k in keys:
        d = d.filter(F.col(k).isNotNull())
    return d


def collapse_duplicate_x(df: DataFrame, x: str, ys: Sequence[str]) -> DataFrame:
    """AGG2: mean of every numeric column (and the y columns) per x, sorted by x."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name != x]
    cols = list(dict.fromkeys(num + [y for y in ys if y != x]))
    return df.filter(F.col(x).isNotNull()).groupBy(x).agg(*[F.avg(c).alias(c) for c in cols]).orderBy(x)


def histogram(df: DataFrame, x: str, bins: int = 30, color: str | None = None) -> DataFrame:
    """AGG4: equal-width histogram over [min, max] (max falls in the last bin), optionally by color.

    Bounds are a scalar sub-query; counting is one partial aggregate.
    """
    from ..functions.columns import dlit, one_row
    v = F.col(x).cast("double")
    b = one_row(df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")))
    lo, hi = dlit(b.get("lo") or 0.0), dlit(b.get("hi") or 0.0)
    width = (hi - lo) / F.lit(float(bins))
    idx = F.when(hi == lo, F.lit(1)).otherwise(
        F.least(F.floor((v - lo) / (hi - lo) * F.lit(float(bins))) + 1, F.lit(bins)))
    keys = [idx.cast("int").alias("bin")] + ([F.col(color)] if color else [])
    out = df.filter(v.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return out.select("*", (lo + (F.col("bin") - 1) * width).alias("bin_lo"), (lo + F.col("bin") * width).alias("bin_hi"))


def box_stats(df: DataFrame, y: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG5: q1, median, q3, whiskers (most extreme points within 1.5 IQR), outlier count per group."""
    from ..functions.columns import dlit, exact_quantiles, grouped_quantiles
    v = F.col(y).cast("double")
    keys = list(by)
    base = df.filter(v.isNotNull()).select(*keys, v.alias("_v"))
    if keys:
        q = grouped_quantiles(base, keys, "_v", [0.25, 0.5, 0.75])
        q = q.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
        j = base.join(q, keys)  # q has one row per group; AQE broadcasts it when small
    else:
        qs = exact_quantiles(base, ["_v"], [0.25, 0.5, 0.75])["_v"]
        j = base.select("_v", dlit(qs[0]).alias("q1"), dlit(qs[1]).alias("median"), dlit(qs[2]).alias("q3"))
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    agg = j.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(F.col("_v") >= lo, F.col("_v"))).alias("lower_whisker"),
        F.max(F.when(F.col("_v") <= hi, F.col("_v"))).alias("upper_whisker"),
        F.count(F.when((F.col("_v") < lo) | (F.col("_v") > hi), 1)).alias("outliers"),
        F.count(F.lit(1)).alias("n"))
    return agg


def pie_counts(df: DataFrame, key: str) -> DataFrame:
    """AGG6: value counts of the color (or x) column."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def categorical_color(df: DataFrame, color: str, max_levels: int = 10) -> DataFrame:
    """AGG7: cast the color key to string when it is non-numeric or has <= ``max_levels`` values
    (a schema decision: one bounded distinct count)."""
    if not isinstance(df.schema[color].dataType, NUMERIC):
        return df.withColumn(color, F.col(color).cast("string"))
    n = df.agg(F.count_distinct(color)).collect()[0][0]
    return df.withColumn(color, F.col(color).cast("string")) if n <= max_levels else df
