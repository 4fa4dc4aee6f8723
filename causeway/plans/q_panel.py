"""Registered queries: chart data (AGG1-AGG7) and panel shaping (TS1-TS13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd, sql_rnd
from ..operators import chartdata as A
from ..operators import panel as TS
from .registry import query
from .views import SQL_V4, SQL_V4_DAILY, SQL_V5, table, v4_daily, v4_events, v5_orders

# AGG ----------------------------------------------------------------------------------------------


@query("agg1_group_mean", sql=f"""SELECT o_orderpriority, o_orderstatus, {sql_rnd('avg(o_totalprice)', 4)} AS o_totalprice
FROM orders GROUP BY 1, 2""")
def agg1_group_mean(spark, sf_dir):
    """AGG1 mean o_totalprice by x = priority and color = status."""
    g = A.group_aggregate(table(spark, sf_dir, "orders"), "o_orderpriority", ["o_totalprice"], "Mean",
                          color="o_orderstatus")
    return g.select("o_orderpriority", "o_orderstatus", rnd("o_totalprice", 4).alias("o_totalprice"))


@query("agg1_group_median", sql=f"""SELECT l_returnflag, {sql_rnd('quantile_cont(l_extendedprice, 0.5)', 4)} AS l_extendedprice,
  {sql_rnd('quantile_cont(l_quantity, 0.5)', 4)} AS l_quantity FROM lineitem GROUP BY 1""")
def agg1_group_median(spark, sf_dir):
    """AGG1 exact median by group."""
    g = A.group_aggregate(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_extendedprice", "l_quantity"], "Median")
    return g.select("l_returnflag", rnd("l_extendedprice", 4).alias("l_extendedprice"),
                    rnd("l_quantity", 4).alias("l_quantity"))


_LI_MEANS = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("agg2_collapse_x", sql="SELECT l_linenumber, " + ", ".join(f"{sql_rnd(f'avg({c})', 4)} AS {c}" for c in _LI_MEANS)
       + " FROM lineitem GROUP BY 1")
def agg2_collapse_x(spark, sf_dir):
    """AGG2 duplicate-x collapse: mean of every numeric column per x."""
    g = A.collapse_duplicate_x(table(spark, sf_dir, "lineitem"), "l_linenumber", ["l_extendedprice"])
    return g.select("l_linenumber", *[rnd(c, 4).alias(c) for c in _LI_MEANS])


@query("agg3_facet", sql=f"""SELECT o_orderstatus, o_orderpriority, {sql_rnd('sum(o_totalprice)', 2)} AS o_totalprice
FROM orders GROUP BY 1, 2""")
def agg3_facet(spark, sf_dir):
    """AGG3 facet split kept as a group key: sum by (facet = status, x = priority)."""
    g = A.group_aggregate(table(spark, sf_dir, "orders"), "o_orderpriority", ["o_totalprice"], "Sum",
                          facet="o_orderstatus")
    return g.select("o_orderstatus", "o_orderpriority", rnd("o_totalprice", 2).alias("o_totalprice"))


@query("agg4_histogram", sql=f"""WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
h AS (SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((l_extendedprice - lo) / (hi - lo) * 30.0) + 1, 30) END AS INTEGER) AS bin,
  l_returnflag, count(*) AS count FROM lineitem, b GROUP BY 1, 2)
SELECT bin, l_returnflag, count, {sql_rnd('lo + (bin - 1) * ((hi - lo) / 30.0)', 4)} AS bin_lo,
  {sql_rnd('lo + bin * ((hi - lo) / 30.0)', 4)} AS bin_hi FROM h, b""")
def agg4_histogram(spark, sf_dir):
    """AGG4 30-bin histogram of l_extendedprice by return flag."""
    h = A.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 30, "l_returnflag")
    return h.select("bin", "l_returnflag", "count", rnd("bin_lo", 4).alias("bin_lo"), rnd("bin_hi", 4).alias("bin_hi"))


@query("agg5_box", sql=f"""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1,
  quantile_cont(l_extendedprice, 0.5) AS med, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT l.l_returnflag, {sql_rnd('q1', 4)} AS q1, {sql_rnd('med', 4)} AS median, {sql_rnd('q3', 4)} AS q3,
  {sql_rnd('min(CASE WHEN l_extendedprice >= q1 - 1.5 * (q3 - q1) THEN l_extendedprice END)', 4)} AS lower_whisker,
  {sql_rnd('max(CASE WHEN l_extendedprice <= q3 + 1.5 * (q3 - q1) THEN l_extendedprice END)', 4)} AS upper_whisker,
  count(*) FILTER (WHERE l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) AS outliers,
  count(*) AS n FROM lineitem l JOIN q ON l.l_returnflag = q.l_returnflag GROUP BY l.l_returnflag, q1, med, q3""")
def agg5_box(spark, sf_dir):
    """AGG5 box-plot statistics of l_extendedprice by return flag."""
    b = A.box_stats(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return b.select("l_returnflag", rnd("q1", 4).alias("q1"), rnd("median", 4).alias("median"), rnd("q3", 4).alias("q3"),
                    rnd("lower_whisker", 4).alias("lower_whisker"), rnd("upper_whisker", 4).alias("upper_whisker"),
                    "outliers", "n")


@query("agg6_pie", sql="SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def agg6_pie(spark, sf_dir):
    """AGG6 pie counts of o_orderpriority."""
    return A.pie_counts(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("agg7_categorical_color", sql="""SELECT CAST(l_linenumber AS VARCHAR) AS l_linenumber, count(*) AS count
FROM lineitem GROUP BY 1""")
def agg7_categorical_color(spark, sf_dir):
    """AGG7 l_linenumber (7 levels) is cast to a categorical color key, then counted."""
    d = A.categorical_color(table(spark, sf_dir, "lineitem").select("l_linenumber"), "l_linenumber")
    return A.pie_counts(d, "l_linenumber")


# TS -----------------------------------------------------------------------------------------------

@query("ts1_aggregate_series", sql=f"""WITH {SQL_V4}
SELECT date, {sql_rnd('avg(value)', 6)} AS value, {sql_rnd('avg(user_id)', 6)} AS user_id FROM v4 GROUP BY date""")
def ts1_aggregate_series(spark, sf_dir):
    """TS1 mean outcome and covariate per date over all events."""
    s = TS.aggregate_series(v4_events(spark, sf_dir), "date", "value", ["user_id"])
    return s.select("date", rnd("value", 6).alias("value"), rnd("user_id", 6).alias("user_id"))


@query("ts2_unit_series", sql=f"""WITH {SQL_V4}
SELECT date, {sql_rnd('avg(value)', 6)} AS value FROM v4 WHERE event_type = 'purchase' GROUP BY date""")
def ts2_unit_series(spark, sf_dir):
    """TS2 single-unit (purchase) mean per date."""
    s = TS.unit_series(v4_events(spark, sf_dir), "date", "event_type", "purchase", "value")
    return s.select("date", rnd("value", 6).alias("value"))


_TYPES = ["purchase", "click", "error", "signup", "view"]


@query("ts3_panel_pivot", sql=f"""WITH {SQL_V4}
SELECT date, """ + ", ".join(f"{sql_rnd(f'sum(CASE WHEN event_type = {chr(39)}{t}{chr(39)} THEN value END)', 4)} AS {t}"
                             for t in _TYPES) + " FROM v4 GROUP BY date")
def ts3_panel_pivot(spark, sf_dir):
    """TS3 wide date x unit sum, treated unit (purchase) first."""
    w = TS.panel_pivot(v4_events(spark, sf_dir), "date", "event_type", "value", treated="purchase")
    return w.select("date", *[rnd(F.col(t), 4).alias(t) for t in _TYPES])


@query("ts4_join_covariates", sql=f"""WITH {SQL_V4},
p AS (SELECT date, sum(value) AS y FROM v4 GROUP BY date),
c AS (SELECT date, avg(user_id) AS user_id FROM v4 WHERE event_type = 'purchase' GROUP BY date)
SELECT p.date, {sql_rnd('y', 4)} AS y, {sql_rnd('user_id', 6)} AS user_id FROM p LEFT JOIN c ON p.date = c.date""")
def ts4_join_covariates(spark, sf_dir):
    """TS4 left join of the treated unit's per-date covariate means onto the panel."""
    e = v4_events(spark, sf_dir)
    panel = e.groupBy("date").agg(F.sum("value").alias("y"))
    j = TS.join_treated_covariates(panel, e, "date", "event_type", "purchase", ["user_id"])
    return j.select("date", rnd("y", 4).alias("y"), rnd("user_id", 6).alias("user_id"))


_GAPPY = "SELECT user_id AS unit, CAST(ts AS DATE) AS date, sum(value) AS y FROM events GROUP BY 1, 2"


@query("ts5_daily_ffill", sql=f"""WITH g AS ({_GAPPY}),
b AS (SELECT unit, min(date) AS lo, max(date) AS hi FROM g GROUP BY unit),
s AS (SELECT unit, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM b),
j AS (SELECT s.unit, s.date, g.y FROM s LEFT JOIN g ON s.unit = g.unit AND s.date = g.date)
SELECT unit, date, {sql_rnd('last_value(y IGNORE NULLS) OVER (PARTITION BY unit ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 4)} AS y
FROM j""")
def ts5_daily_ffill(spark, sf_dir):
    """TS5 daily spine per user + forward fill of the users' daily sums (users miss days)."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.col("user_id").alias("unit"), F.to_date("ts").alias("date")).agg(F.sum("value").alias("y"))
    r = TS.daily_regularize(g, "date", ["y"], "unit")
    return r.select("unit", "date", rnd("y", 4).alias("y"))


def _daily_sql(ctes: str, values: dict[str, int]) -> str:
    """Daily spine of the series ``r`` with every value (name: decimals) filled forward."""
    filled = ", ".join(f"{sql_rnd(f'last_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', n)} AS {c}" for c, n in values.items())
    return f"""WITH {ctes}, b AS (SELECT min(date) AS lo, max(date) AS hi FROM r),
d AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM b),
j AS (SELECT d.date, {', '.join(f'r.{c}' for c in values)} FROM d LEFT JOIN r ON d.date = r.date)
SELECT date, {filled} FROM j"""


@query("ts_series_panel", sql=_daily_sql(f"""{SQL_V4},
w AS (SELECT date, """ + ", ".join(f"sum(CASE WHEN event_type = '{t}' THEN value END) AS {t}" for t in _TYPES) + """ FROM v4 GROUP BY date),
c AS (SELECT date, avg(user_id) AS user_id FROM v4 WHERE event_type = 'purchase' GROUP BY date),
r AS (SELECT w.*, user_id FROM w LEFT JOIN c ON w.date = c.date)""", {**dict.fromkeys(_TYPES, 4), "user_id": 6}))
def ts_series_panel(spark, sf_dir):
    """TS3 + TS4 + TS5 in one: a column per event type, purchase first, its covariate, daily."""
    s = TS.causal_series(table(spark, sf_dir, "events"), "ts", "value", "event_type", "purchase", True, ["user_id"])
    return s.select(F.col("ts").alias("date"), *[rnd(t, 4).alias(t) for t in _TYPES], rnd("user_id", 6).alias("user_id"))


@query("ts_series_unit", sql=_daily_sql(f"""{SQL_V5},
r AS (SELECT date, avg(o_totalprice) AS o_totalprice, avg(o_orderkey) AS o_orderkey FROM v5 WHERE unit = 'NATION_0' GROUP BY date)""", {"o_totalprice": 4, "o_orderkey": 4}))
def ts_series_unit(spark, sf_dir):
    """TS2 + TS5 in one: monthly means of one nation, filled to days."""
    s = TS.causal_series(v5_orders(spark, sf_dir), "date", "o_totalprice", "unit", "NATION_0", covariates=["o_orderkey"])
    return s.select("date", *[rnd(c, 4).alias(c) for c in ("o_totalprice", "o_orderkey")])


@query("ts_series_all", sql=_daily_sql(f"""{SQL_V5}, r AS (SELECT date, avg(o_totalprice) AS o_totalprice FROM v5 GROUP BY date)""", {"o_totalprice": 4}))
def ts_series_all(spark, sf_dir):
    """TS1 + TS5 in one: monthly means of all orders, filled to days."""
    s = TS.causal_series(v5_orders(spark, sf_dir), "date", "o_totalprice")
    return s.select("date", rnd("o_totalprice", 4).alias("o_totalprice"))


@query("ts6_bayes_panel", sql=f"""WITH g AS (SELECT user_id AS unit, CAST(ts AS DATE) AS date, avg(value) AS y
  FROM events GROUP BY 1, 2),
c AS (SELECT CAST(ts AS DATE) AS date, avg(event_id) AS cov FROM events GROUP BY 1),
j AS (SELECT u.unit, c.date, g.y, c.cov FROM (SELECT DISTINCT unit FROM g) u, c LEFT JOIN g ON g.unit = u.unit AND g.date = c.date),
f AS (SELECT unit, date, cov,
  coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY unit ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(y IGNORE NULLS) OVER (PARTITION BY unit ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y
  FROM j)
SELECT unit, date, {sql_rnd('y', 4)} AS y, {sql_rnd('cov', 4)} AS cov FROM f""")
def ts6_bayes_panel(spark, sf_dir):
    """TS6 mean kpi on the grid of users and dates with per-date covariate means, ffill + bfill per user."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("date"), "value", "event_id")
    f = TS.bayes_panel_long(e, "date", "user_id", "value", ["event_id"])
    return f.select(F.col("user_id").alias("unit"), "date", rnd("y", 4).alias("y"), rnd("event_id", 4).alias("cov"))


@query("ts7_intervention_index", sql=f"""WITH {SQL_V4}, d AS (SELECT DISTINCT date FROM v4),
r AS (SELECT date, CAST(dense_rank() OVER (ORDER BY date) AS INTEGER) AS idx FROM d),
a AS (SELECT min(CASE WHEN date >= DATE '2024-01-21' THEN idx END) AS start_idx, max(idx) AS max_idx FROM r)
SELECT start_idx, least(start_idx + 14 - 1, max_idx) AS end_idx, max_idx FROM a""")
def ts7_intervention_index(spark, sf_dir):
    """TS7 intervention start/end as 1-based date positions (start 2024-01-21, 14 days)."""
    return TS.intervention_index(v4_events(spark, sf_dir), "date", "2024-01-21", 14)


@query("ts8_balanced_panel", sql=f"""WITH {SQL_V5},
g AS (SELECT lower(unit) AS location, date, sum(o_totalprice) AS y FROM v5 GROUP BY 1, 2),
n AS (SELECT count(DISTINCT date) AS nd FROM g),
k AS (SELECT location FROM g GROUP BY location HAVING count(*) = (SELECT nd FROM n))
SELECT location, date, {sql_rnd('y', 2)} AS Y FROM g WHERE location IN (SELECT location FROM k)""")
def ts8_balanced_panel(spark, sf_dir):
    """TS8 balanced monthly nation panel (locations missing a month are dropped)."""
    b = TS.balanced_panel(v5_orders(spark, sf_dir), "date", "unit", "o_totalprice")
    return b.select("location", "date", rnd("Y", 2).alias("Y"))


@query("ts9_pre_post", sql=f"""WITH {SQL_V4_DAILY}
SELECT unit, date, CAST(date >= DATE '2024-01-21' AS INTEGER) AS is_post FROM v4d""")
def ts9_pre_post(spark, sf_dir):
    """TS9 pre/post split with range validation."""
    return TS.split_pre_post(v4_daily(spark, sf_dir), "date", "2024-01-21").select("unit", "date", "is_post")


@query("ts10_default_intervention", sql=f"""WITH {SQL_V4}, b AS (SELECT min(date) AS lo, max(date) AS hi FROM v4)
SELECT CASE WHEN DATE '2023-11-01' > lo AND DATE '2023-11-01' < hi THEN DATE '2023-11-01'
  ELSE CAST(lo + CAST(trunc(datediff('day', lo, hi) / 2) AS INTEGER) AS DATE) END AS intervention FROM b""")
def ts10_default_intervention(spark, sf_dir):
    """TS10 default intervention date (range midpoint)."""
    return TS.default_intervention(v4_events(spark, sf_dir), "date")


@query("ts11_period_week", sql="""SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS period, count(*) AS n,
  CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY 1""")
def ts11_period_week(spark, sf_dir):
    """TS11 weekly (Monday) periods of l_shipdate with counts."""
    p = TS.period_column(table(spark, sf_dir, "lineitem"), "l_shipdate", "Weekly")
    return p.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("ts11_period_quarter", sql="""SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, count(*) AS n
FROM lineitem GROUP BY 1""")
def ts11_period_quarter(spark, sf_dir):
    """TS11 quarterly periods."""
    p = TS.period_column(table(spark, sf_dir, "lineitem"), "l_shipdate", "Quarterly")
    return p.groupBy("period").agg(F.count(F.lit(1)).alias("n"))


@query("ts12_union", sql="""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'""")
def ts12_union(spark, sf_dir):
    """TS12 row union of two class subsets."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return TS.union_all([o.filter(F.col("o_orderstatus") == "F"), o.filter(F.col("o_orderstatus") == "P")])


@query("ts13_impact_series", sql=f"""WITH {SQL_V4_DAILY},
t AS (SELECT date, y FROM v4d WHERE unit = 'purchase'),
c AS (SELECT date, avg(y) AS pred FROM v4d WHERE unit <> 'purchase' GROUP BY date),
j AS (SELECT t.date, t.y, c.pred, CAST(t.date >= DATE '2024-01-21' AS INTEGER) AS is_post FROM t JOIN c ON t.date = c.date)
SELECT date, {sql_rnd('y', 4)} AS observed, {sql_rnd('pred', 4)} AS predicted, {sql_rnd('y - pred', 4)} AS effect,
  {sql_rnd('sum(CASE WHEN is_post = 1 THEN y - pred ELSE 0.0 END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 4)} AS cum_effect,
  is_post FROM j""")
def ts13_impact_series(spark, sf_dir):
    """TS13 observed vs predicted (mean of the other units), pointwise and cumulative post effect."""
    d = v4_daily(spark, sf_dir)
    t = d.filter(F.col("unit") == "purchase").select("date", "y")
    c = d.filter(F.col("unit") != "purchase").groupBy("date").agg(F.avg("y").alias("pred"))
    j = t.join(c, "date").withColumn("is_post", (F.col("date") >= F.lit("2024-01-21").cast("date")).cast("int"))
    s = TS.impact_series(j, None, "date", "y", "pred")
    return s.select("date", rnd("observed", 4).alias("observed"), rnd("predicted", 4).alias("predicted"),
                    rnd("effect", 4).alias("effect"), rnd("cum_effect", 4).alias("cum_effect"), "is_post")
