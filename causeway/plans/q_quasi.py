"""Registered queries: quasi-experimental panels (QX4-QX20), archive estimators (ARC1, ARC3)
and sources / sinks (SRC1-2, SNK1-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd, sql_rnd
from ..operators import archive as ARC
from ..operators import bayes as B
from ..operators import panel as TS
from ..operators import synth as S
from ..session import shared_path
from ..sources import io as IO
from .registry import query
from .views import SQL_V1, SQL_V4_DAILY, SQL_V5, table, v1_lineitem, v4_daily, v5_orders

START_V4 = "2024-01-21"
START_V5 = "1999-01-01"


def _v5_balanced(spark, sf_dir):
    """Monthly nation panel, zero-filled to a balanced grid (unit, date, y, n_orders)."""
    g = (v5_orders(spark, sf_dir).groupBy("unit", "date")
         .agg(F.sum("o_totalprice").alias("y"), F.count(F.lit(1)).cast("double").alias("n_orders")))
    return TS.zero_fill(g, "unit", "date", ["y", "n_orders"], "MONTH")


_V5_FILLED = f"""{SQL_V5},
g AS (SELECT unit, date, sum(o_totalprice) AS y, CAST(count(*) AS DOUBLE) AS x FROM v5 GROUP BY 1, 2),
bnd AS (SELECT min(date) AS lo, max(date) AS hi FROM g), un AS (SELECT DISTINCT unit FROM g),
sp AS (SELECT un.unit, CAST(unnest(generate_series(bnd.lo, bnd.hi, INTERVAL 1 MONTH)) AS DATE) AS date FROM un, bnd),
f AS (SELECT sp.unit, sp.date, coalesce(g.y, 0) AS y, coalesce(g.x, 0) AS x FROM sp LEFT JOIN g
  ON sp.unit = g.unit AND sp.date = g.date)"""


# QX6 / QX7 / QX9 / QX13: synthetic control --------------------------------------------------------

_ONE_DONOR_SQL = f"""WITH {SQL_V4_DAILY},
w AS (SELECT CASE WHEN unit = 'purchase' THEN unit ELSE 'other' END AS unit, date, sum(y) AS y FROM v4d GROUP BY 1, 2),
p AS (SELECT unit, date, y, dense_rank() OVER (ORDER BY date) - 1 AS idx FROM w),
k AS (SELECT min(idx) FILTER (WHERE date >= DATE '{START_V4}') AS p0, max(idx) AS mx FROM p),
kk AS (SELECT p0, least(p0 + 6, mx) AS p1 FROM k),
mu AS (SELECT unit, avg(y) AS mu FROM p, kk WHERE idx < p0 GROUP BY unit),
f AS (SELECT p.unit, p.idx, p.y, p.y - mu.mu AS yf FROM p JOIN mu ON p.unit = mu.unit),
s AS (SELECT t.idx, t.y AS obs, d.yf + (SELECT mu FROM mu WHERE unit = 'purchase') AS pred
  FROM f t JOIN f d ON t.idx = d.idx AND t.unit = 'purchase' AND d.unit = 'other', kk WHERE t.idx <= kk.p1),
r AS (SELECT idx, obs - pred AS u FROM s),
sh AS (SELECT g.range AS shift, sum(CASE WHEN ((r.idx - g.range) % (kk.p1 + 1) + (kk.p1 + 1)) % (kk.p1 + 1)
  BETWEEN kk.p0 AND kk.p1 THEN u ELSE 0 END) AS a FROM r, kk, range(0, (SELECT p1 + 1 FROM kk)) g GROUP BY g.range),
pv AS (SELECT avg(CASE WHEN abs(a) >= (SELECT abs(a) FROM sh WHERE shift = 0) - 1e-12 THEN 1.0 ELSE 0.0 END) AS p FROM sh)
SELECT 'purchase' AS unit, {sql_rnd('avg(CASE WHEN idx BETWEEN p0 AND p1 THEN u END)', 4)} AS ate,
  {sql_rnd('sum(CASE WHEN idx BETWEEN p0 AND p1 THEN u END)', 4)} AS cum,
  {sql_rnd('max(pv.p)', 6)} AS p_value, {sql_rnd('sqrt(sum(CASE WHEN idx < p0 THEN u * u END))', 4)} AS l2_imbalance
FROM r, kk, pv"""


@query("qx6_synth_one_donor", sql=_ONE_DONOR_SQL)
def qx6_synth_one_donor(spark, sf_dir):
    """QX6/QX7/QX9/QX13 with a one-unit donor pool (weight 1): FE-demeaned counterfactual, ATT,
    incremental, conformal cyclic-shift p-value and pre-period L2 imbalance (exact)."""
    d = v4_daily(spark, sf_dir).withColumn("unit", F.when(F.col("unit") == "purchase", F.col("unit")).otherwise("other"))
    r = S.synth_impact(d, "date", "unit", "y", ["purchase"], START_V4, duration=7, with_ci=False)
    return r["impact"].select("unit", rnd("ate", 4).alias("ate"), rnd("cum", 4).alias("cum"),
                              rnd("p_value", 6).alias("p_value"), rnd("l2_imbalance", 4).alias("l2_imbalance"))


@query("qx6_synth_impact")
def qx6_synth_impact(spark, sf_dir):
    """QX6 synthetic control for 'purchase' against the other event types, with the CI by test
    inversion (QX10), percent lift and its relative CI (impact schema)."""
    r = S.synth_impact(v4_daily(spark, sf_dir), "date", "unit", "y", ["purchase"], START_V4, duration=7)
    return r["impact"]


@query("qx6_synth_weights")
def qx6_synth_weights(spark, sf_dir):
    """QX6 donor weights (non-negative, summing to one) for NATION_0 on the monthly nation panel."""
    r = S.synth_impact(_v5_balanced(spark, sf_dir), "date", "unit", "y", ["NATION_0"], START_V5, duration=12,
                       with_ci=False)
    return r["weights"]


@query("qx8_augmented_ridge")
def qx8_augmented_ridge(spark, sf_dir):
    """QX8 ridge-augmented, 'best' and GSYN (interactive fixed effects) synthetic control on the nation panel."""
    p = _v5_balanced(spark, sf_dir)
    ridge = S.synth_impact(p, "date", "unit", "y", ["NATION_0"], START_V5, 12, model="ridge")["impact"]
    best = S.synth_impact(p, "date", "unit", "y", ["NATION_0"], START_V5, 12, model="best")["impact"]
    gsyn = S.synth_impact(p, "date", "unit", "y", ["NATION_0"], START_V5, 12, model="gsyn")["impact"]
    return ridge.unionByName(best).unionByName(gsyn)


def _two_units(spark, sf_dir):
    """purchase against all other event types together: one donor, so its weight is exactly 1."""
    d = v4_daily(spark, sf_dir)
    return d.withColumn("unit", F.when(F.col("unit") == "purchase", F.col("unit")).otherwise("other"))


def _series_columns(df):
    return df.select("unit", "date", *[rnd(c, 4).alias(c) for c in ("observed", "predicted", "effect", "cum_effect")], "is_post")


_TWO_UNITS = f"""{SQL_V4_DAILY},
w AS (SELECT CASE WHEN unit = 'purchase' THEN unit ELSE 'other' END AS unit, date, sum(y) AS y FROM v4d GROUP BY 1, 2),
p AS (SELECT unit, date, y, dense_rank() OVER (ORDER BY date) - 1 AS idx FROM w),
k AS (SELECT min(idx) FILTER (WHERE date >= DATE '{START_V4}') AS p0, max(idx) AS mx FROM p),
kk AS (SELECT p0, least(p0 + 6, mx) AS p1 FROM k),
mu AS (SELECT unit, avg(y) AS mu FROM p, kk WHERE idx < p0 GROUP BY unit),
f AS (SELECT p.*, p.y - mu.mu AS yf, mu.mu FROM p JOIN mu ON p.unit = mu.unit),
s AS (SELECT t.unit, t.date, t.idx, t.y AS obs, d.yf + t.mu AS pred, CAST(t.idx BETWEEN kk.p0 AND kk.p1 AS INTEGER) AS post
  FROM f t JOIN f d ON t.idx = d.idx AND t.unit <> d.unit, kk WHERE t.idx <= kk.p1)"""
_SERIES_SQL = f"""WITH {_TWO_UNITS}
SELECT unit, date, {sql_rnd('obs', 4)} AS observed, {sql_rnd('pred', 4)} AS predicted, {sql_rnd('obs - pred', 4)} AS effect,
  {sql_rnd('sum(CASE WHEN post = 1 THEN obs - pred ELSE 0 END) OVER (ORDER BY date)', 4)} AS cum_effect, post AS is_post FROM s WHERE unit = 'purchase'"""


@query("ts13_synth_series", sql=_SERIES_SQL)
def ts13_synth_series(spark, sf_dir):
    """TS13/SNK3 counterfactual series of the synthetic control with cumulative post effect."""
    r = S.synth_impact(_two_units(spark, sf_dir), "date", "unit", "y", ["purchase"], START_V4, duration=7, with_ci=False)
    return _series_columns(TS.impact_series(r["series"], "unit", "date", "observed", "predicted"))


@query("qx19_placebo_two_units", sql=f"""WITH {_TWO_UNITS},
a AS (SELECT unit, abs(avg(CASE WHEN post = 1 THEN obs - pred END)) / sqrt(sum(CASE WHEN idx < p0 THEN (obs - pred) * (obs - pred) END)) AS ratio
  FROM s, kk GROUP BY unit),
r AS (SELECT unit, ratio, CAST(rank() OVER (ORDER BY floor(ratio * 1e9 + 0.5) DESC) AS INTEGER) AS rank, count(*) OVER () AS units FROM a)
SELECT unit, {sql_rnd('ratio', 6)} AS ratio, rank, units, {sql_rnd('rank * 1.0 / units', 6)} AS placebo_p FROM r WHERE unit = 'purchase'""")
def qx19_placebo_two_units(spark, sf_dir):
    """QX19 with two units (weights exactly 1): both run as treated, rank of the true one."""
    r = S.synth_impact(_two_units(spark, sf_dir), "date", "unit", "y", None, START_V4, duration=7, with_ci=False)
    out = S.placebo_rank(r["impact"], "purchase")
    return out.select("unit", rnd("ratio", 6).alias("ratio"), "rank", "units", rnd("placebo_p", 6).alias("placebo_p"))


_SHIFTS_SQL = """u AS (SELECT s.idx, obs - pred AS u, post, pred FROM s WHERE unit = 'purchase'),
sh AS (SELECT g.range AS shift, sum(CASE WHEN ((u.idx - g.range) % (kk.p1 + 1) + (kk.p1 + 1)) % (kk.p1 + 1) BETWEEN kk.p0 AND kk.p1 THEN u ELSE 0 END) AS a,
  sum(CASE WHEN post = 1 AND ((u.idx - g.range) % (kk.p1 + 1) + (kk.p1 + 1)) % (kk.p1 + 1) BETWEEN kk.p0 AND kk.p1 THEN 1 ELSE 0 END) AS c
  FROM u, kk, range(0, (SELECT p1 + 1 FROM kk)) g GROUP BY g.range),
z AS (SELECT a AS a0, c AS c0 FROM sh WHERE shift = 0),
x AS (SELECT CASE WHEN c < c0 THEN (a0 - a) / (c0 - c) END AS t1, CASE WHEN c < c0 THEN (a0 + a) / (c0 + c) END AS t2 FROM sh, z),
hi AS (SELECT greatest(t1, t2) AS v, row_number() OVER (ORDER BY greatest(t1, t2) DESC NULLS FIRST) AS r, count(*) OVER () AS n FROM x),
lo AS (SELECT least(t1, t2) AS v, row_number() OVER (ORDER BY least(t1, t2) NULLS FIRST) AS r, count(*) OVER () AS n FROM x)"""


def _inversion_sql(alpha: float) -> str:
    """The bounds are the order statistics at which the share of shifts that reach the statistic falls below alpha; null if shift 0 alone does."""
    bound = lambda t: f"(SELECT max(v) FROM {t} WHERE r = CAST(ceil({alpha} * n - 1e-9) AS BIGINT))"
    return f"""WITH {_TWO_UNITS}, {_SHIFTS_SQL}
SELECT 'purchase' AS unit, {sql_rnd('(SELECT avg(u) FROM u WHERE post = 1)', 4)} AS ate, {sql_rnd(bound('lo'), 4)} AS ate_lower, {sql_rnd(bound('hi'), 4)} AS ate_upper"""


def _inverted(spark, sf_dir, alpha):
    r = S.synth_impact(_two_units(spark, sf_dir), "date", "unit", "y", ["purchase"], START_V4, duration=7, alpha=alpha)
    return r["impact"].select("unit", *[rnd(c, 4).alias(c) for c in ("ate", "ate_lower", "ate_upper")])


@query("qx10_test_inversion", sql=_inversion_sql(0.1))
def qx10_test_inversion(spark, sf_dir):
    """QX10 confidence interval by inverting the cyclic-shift test (weights exactly 1)."""
    return _inverted(spark, sf_dir, 0.1)


@query("qx10_unbounded_interval", sql=_inversion_sql(0.03))
def qx10_unbounded_interval(spark, sf_dir):
    """QX10 at a level below one shift's share: no effect can be rejected, the interval has no ends."""
    return _inverted(spark, sf_dir, 0.03)


_REFIT = 51  # effects of the grid

_REFIT_SQL = f"""{_TWO_UNITS},
e AS (SELECT ate, abs(ate) + 4.0 * scale AS half FROM (SELECT avg(CASE WHEN post = 1 THEN obs - pred END) AS ate, sqrt(avg(CASE WHEN post = 0 THEN (obs - pred) * (obs - pred) END)) AS scale
  FROM s WHERE unit = 'purchase')),
g AS (SELECT CAST(range AS INTEGER) AS step, CASE WHEN range < 0 THEN 0.0 ELSE ate + half * (range * (2.0 / {_REFIT - 1}) - 1.0) END AS theta FROM range(-1, {_REFIT}), e),
df AS (SELECT t.idx, CASE WHEN t.idx >= kk.p0 THEN 1 ELSE 0 END AS post, t.y - d.y AS y FROM p t JOIN p d ON t.idx = d.idx AND t.unit = 'purchase' AND d.unit = 'other', kk WHERE t.idx <= kk.p1),
u AS (SELECT step, theta, idx, y - avg(y) OVER (PARTITION BY step) - theta * (post - avg(post) OVER (PARTITION BY step)) AS u FROM df, g),
sh AS (SELECT step, theta, r.range AS shift, sum(CASE WHEN ((u.idx - r.range) % (kk.p1 + 1) + (kk.p1 + 1)) % (kk.p1 + 1) BETWEEN kk.p0 AND kk.p1 THEN u ELSE 0 END) AS a
  FROM u, kk, range(0, (SELECT p1 + 1 FROM kk)) r GROUP BY 1, 2, 3),
pv AS (SELECT sh.step, sh.theta, avg(CASE WHEN abs(sh.a) >= abs(z.a) - 1e-12 THEN 1.0 ELSE 0.0 END) AS p FROM sh JOIN sh z ON z.step = sh.step AND z.shift = 0 GROUP BY 1, 2)"""


def _refitted(spark, sf_dir):
    return S.synth_impact(_two_units(spark, sf_dir), "date", "unit", "y", ["purchase"], START_V4, duration=7, refit=True, grid_size=_REFIT)


@query("qx9_refit_tests", sql=f"""WITH {_REFIT_SQL} SELECT 'purchase' AS unit, step, {sql_rnd('theta', 3)} AS theta, {sql_rnd('p', 6)} AS p_value FROM pv""")
def qx9_refit_tests(spark, sf_dir):
    """QX9 p-value of every effect of a grid, the fit made anew under each null over all periods (weights exactly 1)."""
    return _refitted(spark, sf_dir)["tests"].select("unit", "step", rnd("theta", 3).alias("theta"), rnd("p_value", 6).alias("p_value"))


@query("qx9_refit_interval", sql=f"""WITH {_REFIT_SQL},
b AS (SELECT min(step) AS lo, max(step) AS hi FROM pv WHERE step >= 0 AND p >= 0.1 - 1e-12)
SELECT 'purchase' AS unit, {sql_rnd('(SELECT p FROM pv WHERE step = -1)', 6)} AS p_value, {sql_rnd('(SELECT ate FROM e)', 3)} AS ate,
  {sql_rnd('(SELECT theta FROM pv JOIN b ON step = lo WHERE lo > 0)', 3)} AS ate_lower, {sql_rnd(f'(SELECT theta FROM pv JOIN b ON step = hi WHERE hi < {_REFIT - 1})', 3)} AS ate_upper""")
def qx9_refit_interval(spark, sf_dir):
    """QX9/QX10 p-value of no effect and the interval kept by the refitted tests."""
    return _refitted(spark, sf_dir)["impact"].select("unit", rnd("p_value", 6).alias("p_value"), *[rnd(c, 3).alias(c) for c in ("ate", "ate_lower", "ate_upper")])


@query("qx9_refit_nations")
def qx9_refit_nations(spark, sf_dir):
    """QX9 with refit for NATION_0 against all other nations, 250 effects (impact schema)."""
    return S.synth_impact(_v5_balanced(spark, sf_dir), "date", "unit", "y", ["NATION_0"], START_V5, duration=12, refit=True)["impact"]


@query("qx19_placebo_in_space")
def qx19_placebo_in_space(spark, sf_dir):
    """QX19 every nation as pseudo-treated; rank of NATION_0 among all units."""
    r = S.synth_impact(_v5_balanced(spark, sf_dir), "date", "unit", "y", None, START_V5, duration=12,
                       with_ci=False)
    return S.placebo_rank(r["impact"], "NATION_0")


@query("qx15_unit_correlations", sql=f"""WITH {SQL_V4_DAILY}, p AS (SELECT * FROM v4d WHERE date < DATE '{START_V4}')
SELECT a.unit AS a, b.unit AS b, {sql_rnd('corr(a.y, b.y)', 6)} AS corr, count(*) AS n
FROM p a JOIN p b ON a.date = b.date AND a.unit < b.unit GROUP BY 1, 2""")
def qx15_unit_correlations(spark, sf_dir):
    """QX15 pre-period correlation of every pair of units (market similarity)."""
    d = v4_daily(spark, sf_dir).filter(F.col("date") < F.lit(START_V4).cast("date"))
    c = S.unit_correlations(d)
    return c.select("a", "b", rnd("corr", 6).alias("corr"), "n")


# QX11 / QX12 / QX14: power and market selection --------------------------------------------------

_EFFECTS_FULL = [0.0, 0.05, 0.1, 0.15, 0.2]


@query("qx11_market_power")
def qx11_market_power(spark, sf_dir):
    """QX11/QX14 simulated power per candidate nation x effect (lookback 2, 3-month tests) with
    the budget screen at cpic 1.0."""
    r = S.market_power(_v5_balanced(spark, sf_dir), "date", "unit", "y", duration=3, lookback=2,
                       effects=_EFFECTS_FULL, alpha=0.1, cutoff="2001-01-01", cpic=1.0, budget=1e8)
    return r["power"]


@query("qx12_market_ranking")
def qx12_market_ranking(spark, sf_dir):
    """QX12 MDE at 80 % power and candidate ranking (scaled imbalance < 0.2 = strong fit)."""
    r = S.market_power(_v5_balanced(spark, sf_dir), "date", "unit", "y", duration=3, lookback=2,
                       effects=_EFFECTS_FULL, alpha=0.1)
    return S.rank_markets(r["power"])


# QX5 / QX17 / QX18 / QX20 ------------------------------------------------------------------------

def _given_draws(spark, sf_dir):
    """Draws read from a table: every user's daily mean value per event type stands for one posterior draw of that
    unit's counterfactual; the observed series is the daily mean over all users."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("unit"), F.col("user_id").alias("draw"), F.to_date("ts").alias("date"), "value")
    draws = e.groupBy("unit", "draw", "date").agg(F.avg("value").alias("predicted")).withColumn("chain", F.lit(0))
    return draws, e.groupBy("unit", "date").agg(F.avg("value").alias("y"))


_DRAWS = """e AS (SELECT event_type AS unit, user_id AS draw, CAST(ts AS DATE) AS date, value FROM events),
d AS (SELECT unit, draw, date, avg(value) AS predicted FROM e GROUP BY 1, 2, 3), o AS (SELECT unit, date, avg(value) AS y FROM e GROUP BY 1, 2),
per AS (SELECT d.unit, draw, avg(y - predicted) AS ate, sum(y - predicted) AS cum, sum(predicted) AS ps, sum(y) AS os, avg(y) AS my, avg(predicted) AS mp
  FROM d JOIN o ON d.unit = o.unit AND d.date = o.date GROUP BY 1, 2)"""


@query("qx5_impact_summary", sql=f"""WITH {_DRAWS},
s AS (SELECT unit, avg(ate) AS ate, quantile_cont(ate, 0.025) AS al, quantile_cont(ate, 0.975) AS au, avg(cum) AS cum, quantile_cont(cum, 0.025) AS cl,
  quantile_cont(cum, 0.975) AS cu, avg(cum / ps) AS rel, (least(count(*) FILTER (WHERE ps >= os), count(*) FILTER (WHERE ps <= os)) + 1) * 1.0 / (count(*) + 1) AS p
  FROM per GROUP BY unit)
SELECT unit, {sql_rnd('ate', 4)} AS ate, {sql_rnd('al', 4)} AS ate_lower, {sql_rnd('au', 4)} AS ate_upper, {sql_rnd('cum', 4)} AS cum, {sql_rnd('cl', 4)} AS cum_lower,
  {sql_rnd('cu', 4)} AS cum_upper, {sql_rnd('rel * 100', 4)} AS rel, {sql_rnd('p', 6)} AS p_value, p < 0.05 AS significant FROM s""")
def qx5_impact_summary(spark, sf_dir):
    """QX5 summary of given draws: effects, intervals, tail-area p."""
    draws, observed = _given_draws(spark, sf_dir)
    r = B.impact_summary(draws, observed)
    return r.select("unit", *[rnd(c, 4).alias(c) for c in ("ate", "ate_lower", "ate_upper", "cum", "cum_lower", "cum_upper", "rel")],
                    rnd("p_value", 6).alias("p_value"), "significant")


def _draw_sql(p: str, prob: str) -> str:
    parts = []
    for name, c in (("avg_effect", "ate"), ("cum_effect", "cum")):
        parts.append(f"""SELECT unit, '{name}' AS metric, {c} AS v, my, mp FROM per""")
    return f"""WITH {_DRAWS}, m AS ({' UNION ALL '.join(parts)}),
r AS (SELECT *, row_number() OVER (PARTITION BY unit, metric ORDER BY v) AS r, count(*) OVER (PARTITION BY unit, metric) AS n FROM m),
h AS (SELECT a.unit, a.metric, min_by(a.v, b.v - a.v) AS lo, min_by(b.v, b.v - a.v) AS hi FROM r a JOIN r b
  ON a.unit = b.unit AND a.metric = b.metric AND b.r = a.r + CAST(ceil(0.95 * a.n) AS INTEGER) - 1 GROUP BY 1, 2),
s AS (SELECT unit, metric, avg(v) AS mean, avg(CAST(v > 0 AS DOUBLE)) AS pos, avg(CAST(v < 0 AS DOUBLE)) AS neg, avg(CAST(v <= 0 AS DOUBLE)) AS npos, avg(my) / avg(mp) - 1 AS lift
  FROM m GROUP BY 1, 2)
SELECT s.unit, s.metric, {sql_rnd('mean', 4)} AS mean, {sql_rnd('lo', 4)} AS hdi_lower, {sql_rnd('hi', 4)} AS hdi_upper, {sql_rnd(p, 6)} AS p_value,
  {sql_rnd(prob, 6)} AS prob_effect, {sql_rnd('lift', 6)} AS relative_lift FROM s JOIN h ON s.unit = h.unit AND s.metric = h.metric"""


def _draw_columns(r):
    return r.select("unit", "metric", *[rnd(c, 4).alias(c) for c in ("mean", "hdi_lower", "hdi_upper")],
                    *[rnd(c, 6).alias(c) for c in ("p_value", "prob_effect", "relative_lift")])


@query("qx17_draw_summary", sql=_draw_sql("least(1.0, 2 * least(pos, neg))", "greatest(pos, neg)"))
def qx17_draw_summary(spark, sf_dir):
    """QX17 posterior mean, HDI and two-sided tail probability of given draws."""
    draws, observed = _given_draws(spark, sf_dir)
    return _draw_columns(B.draw_summary(draws, observed))


@query("qx18_directional", sql=_draw_sql("npos", "pos"))
def qx18_directional(spark, sf_dir):
    """QX18 one-sided ('increase') test of given draws."""
    draws, observed = _given_draws(spark, sf_dir)
    return _draw_columns(B.draw_summary(draws, observed, direction="increase"))


@query("qx20_method_comparison")
def qx20_method_comparison(spark, sf_dir):
    """QX20/SNK4 comparison of plain and ridge-augmented synthetic control, each without and with a covariate, for 'purchase'."""
    d = v4_daily(spark, sf_dir)
    keep = ["method", "unit", "ate", "ate_lower", "ate_upper", "cum", "cum_lower", "cum_upper", "rel", "p_value"]
    runs = [(label + note, model, covs) for label, model in (("SC", "none"), ("SC + ridge", "ridge")) for note, covs in (("", ()), (", with covariate", ("n_events",)))]
    return S.method_comparison([S.synth_impact(d, "date", "unit", "y", ["purchase"], START_V4, duration=7, model=m, covariates=c)["impact"].select(*keep) for _, m, c in runs],
                               [label for label, _, _ in runs])


def _three_units(spark, sf_dir):
    """purchase and two donors: with one covariate their adjusted weights are the solution of two equations."""
    return v4_daily(spark, sf_dir).withColumn("unit", F.when(F.col("unit") == "purchase", F.col("unit")).when(F.col("unit").isin("view", "click"), "a").otherwise("b"))


@query("qx6_weights_by_columns", sql=f"""WITH {SQL_V4_DAILY},
w AS (SELECT CASE WHEN unit = 'purchase' THEN unit WHEN unit IN ('view', 'click') THEN 'a' ELSE 'b' END AS unit, date, sum(y) AS y FROM v4d GROUP BY 1, 2),
p AS (SELECT unit, date, y, y - avg(y) OVER (PARTITION BY unit) AS yf FROM w WHERE date < DATE '{START_V4}'),
t AS (SELECT o.yf AS o, a.yf AS a, b.yf AS b FROM p o JOIN p a ON o.date = a.date JOIN p b ON o.date = b.date WHERE o.unit = 'purchase' AND a.unit = 'a' AND b.unit = 'b'),
wt AS (SELECT greatest(0.0, least(1.0, sum((o - b) * (a - b)) / sum((a - b) * (a - b)))) AS wa FROM t),
l AS (SELECT sqrt(sum((o - wa * a - (1 - wa) * b) * (o - wa * a - (1 - wa) * b))) AS l2, sqrt(sum((o - 0.5 * a - 0.5 * b) * (o - 0.5 * a - 0.5 * b))) AS ev FROM t, wt)
SELECT 'purchase' AS treated, donor, {sql_rnd('weight', 4)} AS weight, {sql_rnd('l2', 3)} AS l2_imbalance, {sql_rnd('l2 / ev', 4)} AS scaled_l2_imbalance
FROM (SELECT 'a' AS donor, wa AS weight FROM wt UNION ALL SELECT 'b', 1 - wa FROM wt) x, l WHERE weight > 0""")
def qx6_weights_by_columns(spark, sf_dir):
    """QX6/QX13 weights found by entering donors (two donors: a projection cut to [0, 1]) and both imbalances."""
    r = S.synth_impact(_three_units(spark, sf_dir), "date", "unit", "y", ["purchase"], START_V4, duration=7, with_ci=False, by_columns=True)
    return r["weights"].select("treated", "donor", rnd("weight", 4).alias("weight"), rnd("l2_imbalance", 3).alias("l2_imbalance"),
                               rnd("scaled_l2_imbalance", 4).alias("scaled_l2_imbalance"))


@query("qx6_nations_by_columns")
def qx6_nations_by_columns(spark, sf_dir):
    """QX6 impact for every nation, the weights found by entering donors."""
    return S.synth_impact(_v5_balanced(spark, sf_dir), "date", "unit", "y", None, START_V5, duration=12, by_columns=True)["impact"]


@query("qx6_synth_covariate", sql=f"""WITH {SQL_V4_DAILY},
w AS (SELECT CASE WHEN unit = 'purchase' THEN unit WHEN unit IN ('view', 'click') THEN 'a' ELSE 'b' END AS unit, date, sum(y) AS y, avg(n_events) AS x FROM v4d GROUP BY 1, 2),
p AS (SELECT unit, date, y, x, dense_rank() OVER (ORDER BY date) - 1 AS idx FROM w),
k AS (SELECT min(idx) FILTER (WHERE date >= DATE '{START_V4}') AS p0, max(idx) AS mx FROM p),
kk AS (SELECT p0, least(p0 + 6, mx) AS p1 FROM k),
m AS (SELECT unit, avg(y) AS mu, avg(x) AS z FROM p, kk WHERE idx < p0 GROUP BY unit),
wt AS (SELECT (t.z - b.z) / (a.z - b.z) AS wa FROM m t, m a, m b WHERE t.unit = 'purchase' AND a.unit = 'a' AND b.unit = 'b'),
f AS (SELECT p.unit, idx, y, y - mu AS yf, mu FROM p JOIN m ON p.unit = m.unit),
s AS (SELECT t.idx, t.y AS obs, t.mu + wa * a.yf + (1 - wa) * b.yf AS pred, t.mu + 0.5 * a.yf + 0.5 * b.yf AS even
  FROM f t JOIN f a ON t.idx = a.idx AND a.unit = 'a' JOIN f b ON t.idx = b.idx AND b.unit = 'b', wt, kk WHERE t.unit = 'purchase' AND t.idx <= kk.p1)
SELECT 'purchase' AS unit, {sql_rnd('avg(CASE WHEN idx BETWEEN p0 AND p1 THEN obs - pred END)', 3)} AS ate,
  {sql_rnd('sum(CASE WHEN idx BETWEEN p0 AND p1 THEN obs - pred END)', 3)} AS cum, {sql_rnd('max(wa)', 6)} AS weight_a,
  {sql_rnd('sqrt(sum(CASE WHEN idx < p0 THEN (obs - pred) * (obs - pred) END))', 3)} AS l2_imbalance,
  {sql_rnd('sqrt(sum(CASE WHEN idx < p0 THEN (obs - pred) * (obs - pred) END) / sum(CASE WHEN idx < p0 THEN (obs - even) * (obs - even) END))', 6)} AS scaled_l2_imbalance
FROM s, kk, wt""")
def qx6_synth_covariate(spark, sf_dir):
    """QX6/QX13 with a covariate and two donors: adjusted weights, ATT, imbalance and its ratio to uniform weights (exact)."""
    r = S.synth_impact(_three_units(spark, sf_dir), "date", "unit", "y", ["purchase"], START_V4, duration=7, with_ci=False, covariates=["n_events"])
    w = r["weights"].filter("donor = 'a'").select(F.col("treated").alias("unit"), rnd("weight", 6).alias("weight_a"))
    return r["impact"].join(w, "unit").select("unit", *[rnd(c, 3).alias(c) for c in ("ate", "cum")], "weight_a", rnd("l2_imbalance", 3).alias("l2_imbalance"),
                                              rnd("scaled_l2_imbalance", 6).alias("scaled_l2_imbalance"))


# QX11 / QX12 / QX14 with two markets: one donor each, so everything is exact --------------------------

_POWER_EFFECTS = [0.0, 0.05, 0.1, 0.2, 0.4, 0.8, 1.6]
_POWER_SQL = f"""{SQL_V4_DAILY},
w AS (SELECT CASE WHEN unit = 'purchase' THEN unit ELSE 'other' END AS unit, date, sum(y) AS y FROM v4d GROUP BY 1, 2),
p AS (SELECT unit, y, dense_rank() OVER (ORDER BY date) - 1 AS idx FROM w), t AS (SELECT max(idx) + 1 AS t FROM p),
win AS (SELECT range AS k, t - range * 5 AS p0, t - (range - 1) * 5 - 1 AS p1 FROM range(1, 3), t),
pk AS (SELECT p.*, k, p0, p1 FROM p JOIN win ON idx <= p1),
mu AS (SELECT k, unit, avg(y) AS mu FROM pk WHERE idx < p0 GROUP BY 1, 2),
f AS (SELECT pk.*, y - mu AS yf, mu FROM pk JOIN mu USING (k, unit)),
s AS (SELECT a.k, a.unit, a.idx, a.p0, a.p1, a.y AS obs, b.yf + a.mu AS pred FROM f a JOIN f b ON a.k = b.k AND a.idx = b.idx AND a.unit <> b.unit),
sh AS (SELECT s.k, s.unit, g.range AS shift, sum(CASE WHEN ((idx - g.range) % (p1 + 1) + (p1 + 1)) % (p1 + 1) BETWEEN p0 AND p1 THEN obs - pred ELSE 0 END) AS a,
  sum(CASE WHEN idx BETWEEN p0 AND p1 AND ((idx - g.range) % (p1 + 1) + (p1 + 1)) % (p1 + 1) BETWEEN p0 AND p1 THEN pred ELSE 0 END) AS b
  FROM s JOIN range(0, 10000) g ON g.range <= s.p1 GROUP BY 1, 2, 3),
e AS (SELECT CAST(unnest({_POWER_EFFECTS}) AS DOUBLE) AS effect),
st AS (SELECT k, unit, shift, effect, abs(a + effect * b) AS s FROM sh, e),
pv AS (SELECT x.k, x.unit, x.effect, avg(CASE WHEN x.s >= z.s - 1e-12 THEN 1.0 ELSE 0.0 END) AS p
  FROM st x JOIN st z ON x.k = z.k AND x.unit = z.unit AND x.effect = z.effect AND z.shift = 0 GROUP BY 1, 2, 3),
pt AS (SELECT k, unit, sum(CASE WHEN idx >= p0 THEN pred END) AS pp, sum(CASE WHEN idx >= p0 THEN obs - pred END) AS rp,
  sqrt(sum(CASE WHEN idx < p0 THEN (obs - pred) * (obs - pred) END)) AS l2 FROM s GROUP BY 1, 2),
pw AS (SELECT unit AS candidate, effect, avg(CAST(p < 0.1 AS DOUBLE)) AS power, avg((rp + effect * pp) / pp) AS lift, avg(effect * pp) AS inc, avg(l2) AS l2, count(*) AS n
  FROM pv JOIN pt USING (k, unit) GROUP BY 1, 2)"""


def _power_two(spark, sf_dir):
    return S.market_power(_two_units(spark, sf_dir), "date", "unit", "y", duration=5, lookback=2, effects=_POWER_EFFECTS, alpha=0.1, cpic=2.0, budget=5e4)["power"]


@query("qx11_power_two_units", sql=f"""WITH {_POWER_SQL}
SELECT candidate, effect, {sql_rnd('power', 6)} AS power, {sql_rnd('lift', 6)} AS avg_detected_lift, {sql_rnd('inc', 3)} AS avg_incremental,
  {sql_rnd('2.0 * inc', 3)} AS investment, 2.0 * inc <= 5e4 AS within_budget, {sql_rnd('l2', 3)} AS l2_imbalance, n AS simulations FROM pw""")
def qx11_power_two_units(spark, sf_dir):
    """QX11/QX14 simulated power, detected lift, increment, investment and budget of two markets (weights exactly 1)."""
    return _power_two(spark, sf_dir).select("candidate", "effect", rnd("power", 6).alias("power"), rnd("avg_detected_lift", 6).alias("avg_detected_lift"),
                                            rnd("avg_incremental", 3).alias("avg_incremental"), rnd("investment", 3).alias("investment"), "within_budget",
                                            rnd("l2_imbalance", 3).alias("l2_imbalance"), "simulations")


@query("qx12_ranking_two_units", sql=f"""WITH {_POWER_SQL},
m AS (SELECT candidate, min(effect) FILTER (effect > 0 AND power >= 0.8) AS mde, arg_min(lift, effect) FILTER (effect > 0 AND power >= 0.8) AS mde_detected_lift FROM pw GROUP BY 1)
SELECT candidate, mde, {sql_rnd('mde_detected_lift', 6)} AS mde_detected_lift, false AS strong_fit,
  CAST(row_number() OVER (ORDER BY mde NULLS LAST, candidate) AS INTEGER) AS rank FROM m""")
def qx12_ranking_two_units(spark, sf_dir):
    """QX12 minimum detectable effect at 80 % power and ranking of two markets (exact)."""
    return S.rank_markets(_power_two(spark, sf_dir)).select("candidate", "mde", rnd("mde_detected_lift", 6).alias("mde_detected_lift"), "strong_fit", "rank")


@query("qx11_market_sizes")
def qx11_market_sizes(spark, sf_dir):
    """QX11 groups of one to three nations, one-sided, against 200 random choices of months, outcome normalised (rows-only)."""
    return S.market_power(_v5_balanced(spark, sf_dir), "date", "unit", "y", duration=3, lookback=1, effects=[0.0, 0.2], n_markets=[1, 2, 3], side="one_sided",
                          ns=200, normalize=True, covariates=["n_orders"])["power"]


@query("qx15_neighbours_corr", sql=f"""WITH {_V5_FILLED},
c AS (SELECT a.unit, b.unit AS other, corr(a.y, b.y) AS score FROM f a JOIN f b ON a.date = b.date AND a.unit <> b.unit WHERE a.date < DATE '{START_V5}' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, other) AS rank FROM c)
SELECT unit, other, {sql_rnd('score', 6)} AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def qx15_neighbours_corr(spark, sf_dir):
    """QX15 the three nations most correlated with each nation."""
    p = _v5_balanced(spark, sf_dir).filter(F.col("date") < F.lit(START_V5).cast("date"))
    return S.neighbours(p, 3).select("unit", "other", rnd("score", 6).alias("score"), "rank")


@query("qx15_neighbours_dtw")
def qx15_neighbours_dtw(spark, sf_dir):
    """QX15 the three nations nearest to each nation by warping distance within six months (rows-only)."""
    p = _v5_balanced(spark, sf_dir).filter(F.col("date") < F.lit(START_V5).cast("date"))
    return S.neighbours(p, 3, "dtw", window=6)


# ARC1 / ARC3 ----------------------------------------------------------------------------------------

@query("arc1_twoway_fe", sql=f"""WITH {_V5_FILLED},
um AS (SELECT unit, avg(y) AS uy, avg(x) AS ux FROM f GROUP BY unit),
tm AS (SELECT date, avg(y) AS ty, avg(x) AS tx FROM f GROUP BY date),
gm AS (SELECT avg(y) AS gy, avg(x) AS gx FROM f),
d AS (SELECT f.unit, y - uy - ty + gy AS yd, x - ux - tx + gx AS xd FROM f JOIN um ON f.unit = um.unit
  JOIN tm ON f.date = tm.date, gm),
bt AS (SELECT sum(xd * yd) / sum(xd * xd) AS b, sum(xd * xd) AS sxx FROM d),
sc AS (SELECT unit, sum(xd * (yd - b * xd)) AS s FROM d, bt GROUP BY unit),
se AS (SELECT sqrt(sum(s * s) * count(*) / (count(*) - 1)) / (SELECT sxx FROM bt) AS se, count(*) AS g FROM sc)
SELECT 'TwoWayFE' AS method, {sql_rnd('b', 4)} AS estimate, {sql_rnd('se', 4)} AS std_error, CAST(g AS BIGINT) AS clusters
FROM bt, se""")
def arc1_twoway_fe(spark, sf_dir):
    """ARC1 revenue ~ order count with nation and month fixed effects, nation-clustered SE."""
    r = ARC.twoway_fixed_effects(_v5_balanced(spark, sf_dir), "unit", "date", "y", "n_orders")
    return r.select("method", rnd("estimate", 4).alias("estimate"), rnd("std_error", 4).alias("std_error"), "clusters")


@query("arc3_rd", sql=f"""WITH {SQL_V1}, b AS (SELECT l_extendedprice AS y, l_quantity - 25.0 AS xc FROM v1
  WHERE abs(l_quantity - 25.0) <= 10)
SELECT 'RD (sharp)' AS method, {sql_rnd('regr_intercept(y, xc) FILTER (WHERE xc >= 0) - regr_intercept(y, xc) FILTER (WHERE xc < 0)', 4)} AS estimate,
  count(*) AS n FROM b""")
def arc3_rd(spark, sf_dir):
    """ARC3 sharp regression discontinuity of price at quantity 25 (bandwidth 10)."""
    r = ARC.regression_discontinuity(v1_lineitem(spark, sf_dir), "l_quantity", "l_extendedprice", 25.0, 10.0)
    return r.select("method", rnd("estimate", 4).alias("estimate"), "n")


@query("arc3_iv", sql=f"""WITH {SQL_V1}
SELECT 'IV (Wald)' AS method, {sql_rnd('covar_samp(status_f, l_extendedprice) / covar_samp(status_f, treated)', 4)} AS estimate,
  count(*) AS n FROM v1""")
def arc3_iv(spark, sf_dir):
    """ARC3 Wald IV: instrument linestatus = F for the discount treatment."""
    r = ARC.wald_iv(v1_lineitem(spark, sf_dir), "status_f", "treated", "l_extendedprice")
    return r.select("method", rnd("estimate", 4).alias("estimate"), "n")


# SRC / SNK ------------------------------------------------------------------------------------------

@query("src2_preview", sql="""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 10""")
def src2_preview(spark, sf_dir):
    """SRC2 first 10 rows by key with dates rendered yyyy-MM-dd."""
    return IO.preview(table(spark, sf_dir, "orders"), "o_orderkey", 10)


@query("snk1_src1_csv_roundtrip", sql="""SELECT o_orderkey, o_orderstatus, o_totalprice,
  CAST(o_orderstatus = 'F' AS INTEGER) AS is_filled FROM orders""")
def snk1_src1_csv_roundtrip(spark, sf_dir):
    """SNK1 + SRC1: write a projection of orders as CSV to the shared folder, read it back with
    header + inferred schema, booleans ('True'/'False') auto-converted to 0/1."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice",
        F.when(F.col("o_orderstatus") == "F", "True").otherwise("False").alias("is_filled"))
    path = IO.write_table(o, shared_path(spark, "snk1"), fmt="csv")
    back = IO.read_csv(spark, path)
    return back.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus",
                       F.col("o_totalprice").cast("double").alias("o_totalprice"), "is_filled")


@query("qx15_dtw")
def qx15_dtw(spark, sf_dir):
    """QX15 DTW distance between 'purchase' and every other event type's pre-period series."""
    d = v4_daily(spark, sf_dir).filter(F.col("date") < F.lit(START_V4).cast("date"))
    return S.unit_dtw(d, ["purchase"])


@query("snk3_series_roundtrip", sql=_SERIES_SQL)
def snk3_series_roundtrip(spark, sf_dir):
    """SNK3 counterfactual series written as parquet to the shared folder and read back."""
    r = S.synth_impact(_two_units(spark, sf_dir), "date", "unit", "y", ["purchase"], START_V4, duration=7, with_ci=False)
    s = TS.impact_series(r["series"], "unit", "date", "observed", "predicted")
    path = IO.write_table(s, shared_path(spark, "snk3"))
    return _series_columns(IO.read_parquet(spark, path))


@query("qx11_market_power_pairs")
def qx11_market_power_pairs(spark, sf_dir):
    """QX11 with n_markets = 2: every nation treated together with the one most correlated with it."""
    r = S.market_power(_v5_balanced(spark, sf_dir), "date", "unit", "y", duration=3, lookback=2,
                       effects=[0.0, 0.1], alpha=0.1, n_markets=2)
    return r["power"]
