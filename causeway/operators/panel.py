"""Panel and time-series shaping (TS1-TS13).

Panels stay in long form (unit, date, value) for all computation; a wide
pivot is produced only as an output format.  Every time-ordered window is
partitioned by unit, so no single task ever holds more than one unit's
series; the only unpartitioned windows run over the distinct-date table,
whose size is the number of dates, not rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class PanelError(ValueError):
    pass


def aggregate_series(df: DataFrame, date: str, outcome: str, covariates: Sequence[str] = ()) -> DataFrame:
    """TS1: mean outcome and covariates per date (null dates dropped)."""
    return (df.filter(F.col(date).isNotNull()).groupBy(date)
            .agg(*[F.avg(c).alias(c) for c in [outcome, *covariates]]))


def unit_series(df: DataFrame, date: str, unit: str, unit_value, outcome: str,
                covariates: Sequence[str] = ()) -> DataFrame:
    """TS2: one unit's mean outcome/covariates per date; raises when the unit is absent."""
    sub = df.filter(F.col(unit) == F.lit(unit_value))
    if sub.limit(1).count() == 0:
        raise PanelError(f"Unit '{unit_value}' not found in column '{unit}'")
    return aggregate_series(sub, date, outcome, covariates)


def unit_values(df: DataFrame, unit: str, treated=None) -> list:
    """Distinct units (treated first, others sorted): the columns of a wide panel, which is a schema."""
    vals = [r[0] for r in df.select(unit).filter(F.col(unit).isNotNull()).distinct().orderBy(unit).collect()]
    if treated is not None:
        if treated not in vals:
            raise PanelError(f"Treated unit '{treated}' not found")
        vals = [treated] + [v for v in vals if v != treated]
    return vals


def panel_pivot(df: DataFrame, date: str, unit: str, outcome: str, treated=None, how: str = "sum") -> DataFrame:
    """TS3 (sum) / TS6 (mean): wide date x unit table, treated column first (output format only)."""
    vals = unit_values(df, unit, treated)
    fn = F.sum if how == "sum" else F.avg
    wide = df.filter(F.col(date).isNotNull()).groupBy(date).pivot(unit, vals).agg(fn(outcome))
    return wide.select(date, *[F.col(f"`{v}`") for v in vals])


def join_treated_covariates(panel: DataFrame, df: DataFrame, date: str, unit: str, treated,
                            covariates: Sequence[str]) -> DataFrame:
    """TS4: left join of the treated unit's per-date covariate means onto the panel."""
    cov = (df.filter(F.col(unit) == F.lit(treated)).groupBy(date)
           .agg(*[F.avg(c).alias(c) for c in covariates]))
    return panel.join(cov, date, "left")


def daily_regularize(df: DataFrame, date: str, value_cols: Sequence[str], unit: str | None = None) -> DataFrame:
    """TS5: one row per day from each unit's first to last date (sequence + explode, no cross
    join), left-joined and forward filled per unit; leading nulls stay null."""
    keys = [unit] if unit else []
    d = df.withColumn(date, F.to_date(F.col(date)))
    bounds = d.groupBy(*keys).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    spine = bounds.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias(date))
    j = spine.join(d.select(*keys, date, *value_cols), [*keys, date], "left")
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0) if keys else \
        Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return j.select(*keys, date, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in value_cols])


def causal_series(df: DataFrame, date: str, outcome: str, unit: str | None = None, treated=None, use_panel: bool = False,
                  covariates: Sequence[str] = ()) -> DataFrame:
    """TS1-TS5 in one: the daily series that an impact analysis reads, the outcome first, gaps filled forward.

    Without ``unit`` and ``treated``: means over all rows (TS1); with them: means over the treated unit (TS2), or with ``use_panel`` a column
    per unit, the treated one first (TS3), and the treated unit's covariate means (TS4).  Dates are cut to days first, rows without a
    date take no part; raises :class:`PanelError` where the treated unit is absent or a covariate has the name of a unit."""
    rows = df.withColumn(date, F.to_date(F.col(date)))
    if unit is None or treated is None:
        s = aggregate_series(rows, date, outcome, covariates)
    elif not use_panel:
        s = unit_series(rows, date, unit, treated, outcome, covariates)
    else:
        s = panel_pivot(rows, date, unit, outcome, treated)
        clash = sorted(set(covariates) & set(s.columns))
        if clash:
            raise PanelError(f"Covariates with the name of a unit or of the date: {clash}")
        s = join_treated_covariates(s, rows, date, unit, treated, covariates) if covariates else s
    names = s.columns  # the names of units may hold dots and quotes
    values = [f"_v{i}" for i in range(1, len(names))]
    return daily_regularize(s.toDF(date, *values), date, values).toDF(*names)


def fill_both(df: DataFrame, date: str, value_cols: Sequence[str], unit: str | None = None) -> DataFrame:
    """Forward fill then backward fill along dates (per unit)."""
    keys = [unit] if unit else []
    base = Window.partitionBy(*keys).orderBy(date) if keys else Window.orderBy(date)
    fw = base.rowsBetween(Window.unboundedPreceding, 0)
    bw = base.rowsBetween(0, Window.unboundedFollowing)
    out = df.select("*", *[F.last(c, ignorenulls=True).over(fw).alias(f"_f_{c}") for c in value_cols])
    out = out.select(*[x for x in df.columns if x not in value_cols],
                     *[F.coalesce(F.col(f"_f_{c}"), F.first(c, ignorenulls=True).over(bw)).alias(c)
                       for c in value_cols])
    return out


def bayes_panel_long(df: DataFrame, date: str, unit: str, kpi: str, covariates: Sequence[str] = ()) -> DataFrame:
    """TS6 in long form: mean kpi per (unit, date) on the grid of all units and all dates of the table, with the
    per-date covariate means; each unit is filled forward, then backward.  A unit without any value drops out,
    as does a covariate without one (an all-null column of the wide form)."""
    rows = df.filter(F.col(date).isNotNull())
    y = rows.filter(F.col(unit).isNotNull()).groupBy(unit, date).agg(F.avg(kpi).alias("y")).filter(F.col("y").isNotNull())
    from ..functions.columns import one_row
    # the grid is the result's own size: the list of dates, exploded for each unit
    dates = one_row(rows.agg(F.array_sort(F.collect_set(date)).alias("d")))["d"]
    every = F.array(*[F.lit(d) for d in dates]).cast(f"array<{rows.schema[date].dataType.simpleString()}>")
    grid = y.select(unit).distinct().select(unit, F.explode(every).alias(date))
    out = grid.join(y, [unit, date], "left")
    kept = list(covariates)
    if kept:
        seen = one_row(rows.agg(*[F.count(c).alias(c) for c in kept]))
        kept = [c for c in kept if seen[c]]
        out = out.join(rows.groupBy(date).agg(*[F.avg(c).alias(c) for c in kept]), date, "left") if kept else out
    return fill_both(out, date, ["y", *kept], unit).select(unit, date, "y", *kept)


def intervention_index(df: DataFrame, date: str, start: str, duration: int) -> DataFrame:
    """TS7: 1-based positions of the sorted distinct dates; start = first date >= ``start``,
    end = min(start + duration - 1, last).  The window runs over distinct dates only."""
    dates = df.select(F.to_date(date).alias("d")).filter(F.col("d").isNotNull()).distinct()
    ranked = dates.select("d", F.dense_rank().over(Window.orderBy("d")).alias("idx"))
    agg = ranked.agg(F.min(F.when(F.col("d") >= F.lit(start).cast("date"), F.col("idx"))).alias("start_idx"),
                     F.max("idx").alias("max_idx"))
    return agg.select("start_idx", F.least(F.col("start_idx") + duration - 1, F.col("max_idx")).alias("end_idx"),
                      "max_idx")


def balanced_panel(df: DataFrame, date: str, location: str, kpi: str) -> DataFrame:
    """TS8: lower-cased locations, kpi summed per (location, date); locations missing any of
    the panel's dates are dropped (distinct-date count collected once, dates per location by a
    window partitioned by location)."""
    g = (df.select(F.lower(F.col(location)).alias("location"), F.col(date).alias("date"), F.col(kpi).alias("Y"))
         .filter(F.col("location").isNotNull() & F.col("date").isNotNull())
         .groupBy("location", "date").agg(F.sum("Y").alias("Y")))
    from ..functions.columns import one_row
    n_dates = one_row(g.select("date").distinct().agg(F.count(F.lit(1)).alias("n")))["n"]
    # dates per location by a window partitioned by location (one location's dates per task)
    per_loc = F.count(F.lit(1)).over(Window.partitionBy("location"))
    return g.select("*", per_loc.alias("_n")).filter(F.col("_n") == F.lit(n_dates)).drop("_n")


def split_pre_post(df: DataFrame, date: str, intervention: str) -> DataFrame:
    """TS9: adds ``is_post`` (date >= intervention); raises unless min < intervention < max."""
    b = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi")).collect()[0]
    t = F.lit(intervention).cast("date")
    import datetime as _dt
    iv = _dt.date.fromisoformat(intervention)
    lo, hi = b["lo"], b["hi"]
    lo = lo.date() if hasattr(lo, "date") else lo
    hi = hi.date() if hasattr(hi, "date") else hi
    if lo is None or not (lo < iv < hi):
        raise PanelError(f"intervention {intervention} must lie strictly between {lo} and {hi}")
    return df.withColumn("is_post", (F.to_date(date) >= t).cast("int"))


def default_intervention(df: DataFrame, date: str, demo_date: str = "2023-11-01") -> DataFrame:
    """TS10: midpoint of the date range, or the demo date when it lies inside the range."""
    d = F.to_date(date)
    b = df.agg(F.min(d).alias("lo"), F.max(d).alias("hi"))
    mid = F.date_add("lo", (F.datediff("hi", "lo") / 2).cast("int"))
    demo = F.lit(demo_date).cast("date")
    return b.select(F.when((demo > F.col("lo")) & (demo < F.col("hi")), demo).otherwise(mid).alias("intervention"))


def period_column(df: DataFrame, date: str, freq: str = "Weekly", name: str = "period") -> DataFrame:
    """TS11: period start (Weekly = Monday, Monthly, Quarterly)."""
    unit = {"Weekly": "week", "Monthly": "month", "Quarterly": "quarter"}[freq]
    return df.withColumn(name, F.to_date(F.date_trunc(unit, F.col(date))))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """TS12: row union by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def impact_series(df: DataFrame, unit: str | None, date: str, observed: str, predicted: str,
                  lower: str | None = None, upper: str | None = None, post: str = "is_post") -> DataFrame:
    """TS13: pointwise effect and cumulative effect over post rows (window per unit)."""
    keys = [unit] if unit else []
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(date) \
        .rowsBetween(Window.unboundedPreceding, 0)
    eff = F.col(observed) - F.col(predicted)
    post_eff = F.when(F.col(post) == 1, eff).otherwise(F.lit(0.0))
    return df.select(*keys, date, F.col(observed).alias("observed"), F.col(predicted).alias("predicted"),
                     (F.col(lower) if lower else F.lit(None).cast("double")).alias("lower"),
                     (F.col(upper) if upper else F.lit(None).cast("double")).alias("upper"),
                     eff.alias("effect"), F.sum(post_eff).over(w).alias("cum_effect"),
                     F.col(post).alias("is_post"))


def zero_fill(panel: DataFrame, unit: str, date: str, values: Sequence[str], step: str = "MONTH") -> DataFrame:
    """Balance a panel: every unit gets every period between the global first and last date
    (per-unit ``explode(sequence)`` over scalar-subquery bounds, no cross join); missing
    cells are 0 (sum semantics of a pivot over existing groups)."""
    from ..functions.columns import one_row
    b = one_row(panel.agg(F.min(date).alias("lo"), F.max(date).alias("hi")))
    units = panel.select(unit).distinct()
    spine = units.select(unit, F.explode(F.sequence(F.lit(b["lo"]), F.lit(b["hi"]),
                                                    F.expr(f"INTERVAL 1 {step}"))).alias(date))
    return spine.join(panel, [unit, date], "left").fillna(0, subset=list(values))
