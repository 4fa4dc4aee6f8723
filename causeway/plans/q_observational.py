"""Registered queries: observational estimators, heterogeneity and refutation
(EST1-EST14, HTE1-HTE5, REF1-REF4, ARC2) on the lineitem / orders views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import (rnd, sql_poisson1, sql_replicate_values, sql_rnd, sql_row_seed,
                                 sql_stream_u, sql_uniform)
from ..operators import cells, effects, forest, hte, observational as O, refute
from ..operators.regression import logit_effect, ols_effect
from .registry import query
from .views import SQL_V1, SQL_V3, table, v1_lineitem

CELLS = ["l_linestatus", "l_linenumber"]


def _v1(spark, sf_dir):
    v = v1_lineitem(spark, sf_dir)
    return v.withColumn("rid", F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))


SQL_V1R = SQL_V1 + ", v1r AS (SELECT *, concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS rid FROM v1)"


def _eff(df, d=4):
    return df.select("method", "n", rnd("estimate", d).alias("estimate"), rnd("std_error", d).alias("std_error"),
                     rnd("stat", 6).alias("stat"))


# EST1 ---------------------------------------------------------------------------------------------

@query("est1_ols_adjusted", sql=f"""WITH {SQL_V1},
s AS (SELECT count(*) AS n, covar_pop(treated, treated) AS tt, covar_pop(l_quantity, l_quantity) AS xx,
  covar_pop(treated, l_quantity) AS tx, covar_pop(treated, l_extendedprice) AS ty,
  covar_pop(l_quantity, l_extendedprice) AS xy, covar_pop(l_extendedprice, l_extendedprice) AS yy FROM v1),
b AS (SELECT n, (xx * ty - tx * xy) / (tt * xx - tx * tx) AS bt, (tt * xy - tx * ty) / (tt * xx - tx * tx) AS bx,
  tt, xx, tx, ty, xy, yy FROM s),
r AS (SELECT n, bt, sqrt((yy - bt * ty - bx * xy) * n / (n - 3) * xx / ((tt * xx - tx * tx) * n)) AS se FROM b)
SELECT 'OLS' AS method, n, {sql_rnd('bt', 4)} AS estimate, {sql_rnd('se', 4)} AS std_error,
  {sql_rnd('bt / se', 6)} AS stat FROM r""")
def est1_ols_adjusted(spark, sf_dir):
    """EST1 Y=l_extendedprice ~ T (discount >= 0.05) + l_quantity via the Gram aggregate."""
    return _eff(ols_effect(_v1(spark, sf_dir), "treated", "l_extendedprice", ["l_quantity"]))


@query("est1_difference_in_means", sql=f"""WITH {SQL_V1},
c AS (SELECT treated, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) * count(*) AS ss FROM v1 GROUP BY 1),
s AS (SELECT sum(n) AS n, max(CASE WHEN treated = 1 THEN m END) - max(CASE WHEN treated = 0 THEN m END) AS est,
  sqrt(sum(ss) / (sum(n) - 2) * sum(1.0 / n)) AS se FROM c)
SELECT 'OLS' AS method, CAST(n AS BIGINT) AS n, {sql_rnd('est', 4)} AS estimate, {sql_rnd('se', 4)} AS std_error,
  {sql_rnd('est / se', 6)} AS stat FROM s""")
def est1_difference_in_means(spark, sf_dir):
    """EST1 without confounders = difference in means with the pooled OLS standard error."""
    return _eff(ols_effect(_v1(spark, sf_dir), "treated", "l_extendedprice", []))


@query("est1_ols_full")
def est1_ols_full(spark, sf_dir):
    """EST1 full effect row (t-based p-value and CI) with two confounders."""
    return ols_effect(_v1(spark, sf_dir), "treated", "l_extendedprice", ["l_quantity", "l_tax"])


# EST2 / EST3 --------------------------------------------------------------------------------------

_LOGIT_SQL = f"""WITH {SQL_V1},
c AS (SELECT sum(CASE WHEN treated = 1 AND returned = 1 THEN 1 ELSE 0 END) AS a,
  sum(CASE WHEN treated = 1 AND returned = 0 THEN 1 ELSE 0 END) AS b,
  sum(CASE WHEN treated = 0 AND returned = 1 THEN 1 ELSE 0 END) AS c,
  sum(CASE WHEN treated = 0 AND returned = 0 THEN 1 ELSE 0 END) AS d FROM v1),
e AS (SELECT a + b + c + d AS n, ln((a * 1.0 / b) / (c * 1.0 / d)) AS est, sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d) AS se,
  c * 1.0 / (c + d) AS p0 FROM c)
SELECT 'Logit' AS method, CAST(n AS BIGINT) AS n, {sql_rnd('est', 6)} AS estimate, {sql_rnd('se', 6)} AS std_error,
  {sql_rnd('exp(est)', 6)} AS odds_ratio, {sql_rnd('exp(est) * p0 / (1 - p0 + exp(est) * p0) - p0', 6)} AS risk_diff FROM e"""


@query("est2_logit", sql=_LOGIT_SQL)
def est2_logit(spark, sf_dir):
    """EST2 + EST3: logit of returned ~ T (IRLS), odds ratio and implied risk difference."""
    e = logit_effect(_v1(spark, sf_dir), "treated", "returned", [])
    return e.select("method", "n", rnd("estimate", 6).alias("estimate"), rnd("std_error", 6).alias("std_error"),
                    rnd("odds_ratio", 6).alias("odds_ratio"), rnd("risk_diff", 6).alias("risk_diff"))


@query("est2_logit_adjusted")
def est2_logit_adjusted(spark, sf_dir):
    """EST2 with confounders (l_quantity, l_tax): z-based p/CI, odds ratio, risk difference."""
    return logit_effect(_v1(spark, sf_dir), "treated", "returned", ["l_quantity", "l_tax"])


# EST4 / EST5 / EST6 / EST14 -----------------------------------------------------------------------

_PROP = f"""{SQL_V1}, p AS (SELECT *, avg(treated) OVER (PARTITION BY l_linestatus, l_linenumber) AS e FROM v1)"""


@query("est4_propensity_saturated", sql=f"""WITH {_PROP}
SELECT DISTINCT l_linestatus, l_linenumber, {sql_rnd('e', 8)} AS propensity FROM p""")
def est4_propensity_saturated(spark, sf_dir):
    """EST4 saturated propensity e(x) per confounder cell."""
    p = cells.propensity_cells(_v1(spark, sf_dir), "treated", CELLS)
    return p.select(*CELLS, rnd("propensity", 8).alias("propensity"))


@query("est4_propensity_logistic")
def est4_propensity_logistic(spark, sf_dir):
    """EST4 logistic propensity on (l_quantity, l_tax): mean and range of e(x)."""
    p = O.with_propensity(_v1(spark, sf_dir), "treated", ["l_quantity", "l_tax"], mode="logistic")
    return p.agg(F.avg("propensity").alias("mean_propensity"), F.min("propensity").alias("min_propensity"),
                 F.max("propensity").alias("max_propensity"))


@query("est5_iptw", sql=f"""WITH {_PROP}
SELECT 'IPTW' AS method, count(*) AS n,
  {sql_rnd('avg(treated * l_extendedprice / e - (1 - treated) * l_extendedprice / (1 - e))', 4)} AS estimate,
  {sql_rnd('stddev_samp(treated * l_extendedprice / e - (1 - treated) * l_extendedprice / (1 - e)) / sqrt(count(*))', 4)} AS std_error FROM p""")
def est5_iptw(spark, sf_dir):
    """EST5 Horvitz-Thompson IPTW with saturated propensities, from cell sums."""
    p = cells.iptw_cells(_v1(spark, sf_dir), "treated", "l_extendedprice", CELLS)
    return p.select(F.lit("IPTW").alias("method"), "n", rnd("estimate", 4).alias("estimate"), rnd("std_error", 4).alias("std_error"))


@query("est5_iptw_rows", sql=f"""WITH {_PROP}
SELECT 'IPTW' AS method, count(*) AS n,
  {sql_rnd('avg(treated * l_extendedprice / e - (1 - treated) * l_extendedprice / (1 - e))', 4)} AS estimate,
  {sql_rnd('stddev_samp(treated * l_extendedprice / e - (1 - treated) * l_extendedprice / (1 - e)) / sqrt(count(*))', 4)} AS std_error FROM p""")
def est5_iptw_rows(spark, sf_dir):
    """EST5 Horvitz-Thompson IPTW from a propensity column on the rows (any propensity model)."""
    p = O.with_propensity(_v1(spark, sf_dir), "treated", CELLS)
    return O.iptw(p, "treated", "l_extendedprice").select("method", "n", rnd("estimate", 4).alias("estimate"), rnd("std_error", 4).alias("std_error"))


_HAJEK = f"""WITH {_PROP},
s AS (SELECT sum(treated / e) AS w1, sum((1 - treated) / (1 - e)) AS w0, sum(treated * l_extendedprice / e) / sum(treated / e) AS mu1,
  sum((1 - treated) * l_extendedprice / (1 - e)) / sum((1 - treated) / (1 - e)) AS mu0 FROM p)
SELECT 'IPTW (Hajek)' AS method, count(*) AS n, {sql_rnd('max(mu1) - max(mu0)', 4)} AS estimate,
  {sql_rnd('sqrt(sum(power(treated / e * (l_extendedprice - mu1) / w1 - (1 - treated) / (1 - e) * (l_extendedprice - mu0) / w0, 2)))', 4)} AS std_error
FROM p, s"""


@query("est5_iptw_hajek", sql=_HAJEK)
def est5_iptw_hajek(spark, sf_dir):
    """EST5 normalised (Hajek) IPTW with its influence-function SE, from cell sums."""
    p = cells.iptw_cells(_v1(spark, sf_dir), "treated", "l_extendedprice", CELLS, normalized=True)
    return p.select(F.lit("IPTW (Hajek)").alias("method"), "n", rnd("estimate", 4).alias("estimate"), rnd("std_error", 4).alias("std_error"))


@query("est5_iptw_hajek_rows", sql=_HAJEK)
def est5_iptw_hajek_rows(spark, sf_dir):
    """EST5 Hajek IPTW from a propensity column on the rows."""
    p = O.with_propensity(_v1(spark, sf_dir), "treated", CELLS)
    return O.iptw(p, "treated", "l_extendedprice", normalized=True).select(
        "method", "n", rnd("estimate", 4).alias("estimate"), rnd("std_error", 4).alias("std_error"))


@query("est6_psm", sql=f"""WITH {_PROP},
c AS (SELECT treated AS arm, {sql_rnd('e', 6)} AS score, count(*) AS n, avg(l_extendedprice) AS m FROM p GROUP BY 1, 2),
j AS (SELECT t.n AS n1, c0.n AS n0, t.m AS m1, c0.m AS m0 FROM c t JOIN c c0 ON t.score = c0.score AND t.arm = 1 AND c0.arm = 0),
s AS (SELECT sum(n1 * (m1 - m0)) AS s1, sum(n1) AS n1, sum(n0 * (m1 - m0)) AS s0, sum(n0) AS n0 FROM j)
SELECT 'PSM' AS method, 'ATT' AS estimand, {sql_rnd('s1 / n1', 4)} AS estimate, CAST(n1 AS BIGINT) AS n FROM s
UNION ALL SELECT 'PSM', 'ATC', {sql_rnd('s0 / n0', 4)}, CAST(n0 AS BIGINT) FROM s
UNION ALL SELECT 'PSM', 'ATE', {sql_rnd('(s1 + s0) / (n1 + n0)', 4)}, CAST(n1 + n0 AS BIGINT) FROM s""")
def est6_psm(spark, sf_dir):
    """EST6 nearest-neighbour propensity matching (saturated scores) -> ATT, ATC, ATE."""
    p = O.with_propensity(_v1(spark, sf_dir), "treated", CELLS)
    m = O.psm(p, "treated", "l_extendedprice")
    return m.select("method", "estimand", rnd("estimate", 4).alias("estimate"), "n")


_FINE = ["l_quantity", "l_tax", "l_linenumber"]


@query("est6_psm_nearest", sql=f"""WITH {SQL_V1},
p AS (SELECT treated AS arm, l_extendedprice AS y, avg(treated) OVER (PARTITION BY l_quantity, l_tax, l_linenumber) AS score FROM v1),
c AS (SELECT arm, score, count(*) AS n, avg(y) AS m FROM p GROUP BY 1, 2),
w AS (SELECT *, last_value(CASE WHEN arm = 0 THEN score END IGNORE NULLS) OVER up AS b0, last_value(CASE WHEN arm = 1 THEN score END IGNORE NULLS) OVER up AS b1,
  first_value(CASE WHEN arm = 0 THEN score END IGNORE NULLS) OVER down AS a0, first_value(CASE WHEN arm = 1 THEN score END IGNORE NULLS) OVER down AS a1
  FROM c WINDOW up AS (ORDER BY score, arm ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), down AS (ORDER BY score, arm ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
o AS (SELECT arm, score, n, m, CASE WHEN arm = 1 THEN b0 ELSE b1 END AS b, CASE WHEN arm = 1 THEN a0 ELSE a1 END AS a FROM w),
x AS (SELECT *, CASE WHEN b IS NULL OR (a IS NOT NULL AND a - score < score - b) THEN a ELSE b END AS to_score FROM o),
j AS (SELECT x.arm, x.n, CASE WHEN x.arm = 1 THEN x.m - c.m ELSE c.m - x.m END AS d FROM x JOIN c ON c.arm = 1 - x.arm AND c.score = x.to_score),
s AS (SELECT sum(CASE WHEN arm = 1 THEN n * d END) AS s1, sum(CASE WHEN arm = 1 THEN n END) AS n1, sum(CASE WHEN arm = 0 THEN n * d END) AS s0, sum(CASE WHEN arm = 0 THEN n END) AS n0 FROM j)
SELECT 'PSM' AS method, 'ATT' AS estimand, {sql_rnd('s1 / n1', 4)} AS estimate, CAST(n1 AS BIGINT) AS n FROM s
UNION ALL SELECT 'PSM', 'ATC', {sql_rnd('s0 / n0', 4)}, CAST(n0 AS BIGINT) FROM s
UNION ALL SELECT 'PSM', 'ATE', {sql_rnd('(s1 + s0) / (n1 + n0)', 4)}, CAST(n1 + n0 AS BIGINT) FROM s""")
def est6_psm_nearest(spark, sf_dir):
    """EST6 matching on fine cells, many of which lack an arm: the nearest score of the other arm is what counts."""
    m = O.psm(O.with_propensity(_v1(spark, sf_dir), "treated", _FINE), "treated", "l_extendedprice")
    return m.select("method", "estimand", rnd("estimate", 4).alias("estimate"), "n")


@query("est14_standardization", sql=f"""WITH {SQL_V1},
c AS (SELECT l_linestatus, l_linenumber, count(*) AS n, count(*) FILTER (WHERE treated = 1) AS n1,
  count(*) FILTER (WHERE treated = 0) AS n0, avg(CASE WHEN treated = 1 THEN l_extendedprice END) AS mu1,
  avg(CASE WHEN treated = 0 THEN l_extendedprice END) AS mu0 FROM v1 GROUP BY 1, 2)
SELECT 'Standardization (g-formula)' AS method,
  {sql_rnd('sum(CASE WHEN n1 > 0 AND n0 > 0 THEN (mu1 - mu0) * n END) / sum(CASE WHEN n1 > 0 AND n0 > 0 THEN n END)', 4)} AS estimate,
  CAST(sum(CASE WHEN n1 > 0 AND n0 > 0 THEN n END) AS BIGINT) AS n,
  count(*) FILTER (WHERE NOT (n1 > 0 AND n0 > 0)) AS cells_without_overlap,
  CAST(coalesce(sum(CASE WHEN NOT (n1 > 0 AND n0 > 0) THEN n END), 0) AS BIGINT) AS rows_without_overlap FROM c""")
def est14_standardization(spark, sf_dir):
    """EST14 identification via the star-DAG adjustment formula (g-formula over cells)."""
    s = O.standardization(_v1(spark, sf_dir), "treated", "l_extendedprice", CELLS)
    return s.select("method", rnd("estimate", 4).alias("estimate"), "n", "cells_without_overlap",
                    "rows_without_overlap")


# EST9 / EST10 / HTE1 / HTE2 -----------------------------------------------------------------------

_ITE = f"""{SQL_V1}, cm AS (SELECT l_linestatus, l_linenumber, avg(CASE WHEN treated = 1 THEN l_extendedprice END)
  - avg(CASE WHEN treated = 0 THEN l_extendedprice END) AS ite FROM v1 GROUP BY 1, 2),
sc AS (SELECT v1.*, cm.ite FROM v1 LEFT JOIN cm ON v1.l_linestatus = cm.l_linestatus AND v1.l_linenumber = cm.l_linenumber)"""


@query("est10_t_learner", sql=f"""WITH {_ITE}
SELECT 'T-Learner' AS method, {sql_rnd('avg(ite)', 4)} AS estimate, {sql_rnd('stddev_samp(ite)', 4)} AS ite_sd,
  count(*) AS n FROM sc WHERE ite IS NOT NULL""")
def est10_t_learner(spark, sf_dir):
    """EST10 T-learner with cell-mean base learners (= saturated S-learner, EST9): ATE = mean ITE."""
    a = cells.t_learner_cells(_v1(spark, sf_dir), "treated", "l_extendedprice", CELLS)
    return a.select(F.lit("T-Learner").alias("method"), rnd("estimate", 4).alias("estimate"), rnd("ite_sd", 4).alias("ite_sd"), "n")


@query("hte1_ite_scores", sql=f"""WITH {_ITE}
SELECT l_orderkey, l_linenumber, l_partkey, {sql_rnd('ite', 4)} AS Estimated_ITE FROM sc""")
def hte1_ite_scores(spark, sf_dir):
    """HTE1 Estimated_ITE column scored on every row."""
    s = O.t_learner_saturated(_v1(spark, sf_dir), "treated", "l_extendedprice", CELLS)
    return s.select("l_orderkey", "l_linenumber", "l_partkey", rnd("Estimated_ITE", 4).alias("Estimated_ITE"))


_FEATS = ["l_quantity", "l_tax", "l_linenumber"]


@query("hte2_univariate_scan", sql=f"""WITH {_ITE}
""" + "\nUNION ALL\n".join(
    f"""SELECT '{f}' AS feature, {sql_rnd(f'regr_slope(ite, {f})', 6)} AS slope, {sql_rnd(f'regr_r2(ite, {f})', 6)} AS r2,
  CAST(regr_count(ite, {f}) AS BIGINT) AS n FROM sc""" for f in _FEATS))
def hte2_univariate_scan(spark, sf_dir):
    """HTE2 ITE ~ feature scan (slope, r^2, n; p-values unit-tested)."""
    s = O.t_learner_saturated(_v1(spark, sf_dir), "treated", "l_extendedprice", CELLS)
    scan = hte.univariate_scan(s, "Estimated_ITE", _FEATS)
    return scan.select("feature", rnd("slope", 6).alias("slope"), rnd("r2", 6).alias("r2"), "n")


@query("hte3_interaction_scan", sql=f"""WITH {SQL_V1},
""" + ",\n".join(f"""a_{f} AS (SELECT treated, regr_slope(l_extendedprice, {f}) AS b, regr_sxx(l_extendedprice, {f}) AS sxx,
  regr_syy(l_extendedprice, {f}) AS syy, regr_sxy(l_extendedprice, {f}) AS sxy, count(*) AS n FROM v1 GROUP BY 1),
s_{f} AS (SELECT '{f}' AS feature, max(CASE WHEN treated = 1 THEN b END) - max(CASE WHEN treated = 0 THEN b END) AS est,
  sqrt(sum(syy - sxy * sxy / sxx) / (sum(n) - 4) * sum(1.0 / sxx)) AS se, sum(n) AS n FROM a_{f})"""
                 for f in ["l_quantity", "l_tax"]) + "\n" + "\nUNION ALL\n".join(
    f"SELECT feature, {sql_rnd('est', 4)} AS interaction, {sql_rnd('se', 4)} AS std_error, CAST(n AS BIGINT) AS n FROM s_{f}"
    for f in ["l_quantity", "l_tax"]))
def hte3_interaction_scan(spark, sf_dir):
    """HTE3 Y ~ T + X_j + T*X_j per feature from one shared moment aggregate."""
    scan = hte.interaction_scan(_v1(spark, sf_dir), "treated", "l_extendedprice", ["l_quantity", "l_tax"])
    return scan.select("feature", rnd("interaction", 4).alias("interaction"), rnd("std_error", 4).alias("std_error"), "n")


@query("est9_s_learner_rf")
def est9_s_learner_rf(spark, sf_dir):
    """EST9 S-learner with a random forest on (X, T): ATE and ITE spread (rows-only check)."""
    s = O.s_learner_rf(_v1(spark, sf_dir), "treated", "l_extendedprice", ["l_quantity", "l_tax", "l_linenumber"], row_id="rid")
    return O.ate_from_ite(s, method="S-Learner")


@query("est10_t_learner_rf")
def est10_t_learner_rf(spark, sf_dir):
    """EST10 T-learner with random forests per arm (rows-only check)."""
    s = O.t_learner_rf(_v1(spark, sf_dir), "treated", "l_extendedprice", ["l_quantity", "l_tax", "l_linenumber"], row_id="rid")
    return O.ate_from_ite(s, method="T-Learner (RF)")


@query("est10_tree_unit_weights", sql=f"""WITH {SQL_V1}
SELECT l_tax, l_linenumber, {sql_rnd('avg(CASE WHEN treated = 0 THEN l_extendedprice END)', 4)} AS mu0,
  {sql_rnd('avg(CASE WHEN treated = 1 THEN l_extendedprice END)', 4)} AS mu1, count(*) AS n FROM v1 GROUP BY 1, 2
HAVING count(*) FILTER (treated = 0) > 0 AND count(*) FILTER (treated = 1) > 0""")
def est10_tree_unit_weights(spark, sf_dir):
    """EST10 one tree an arm, every row once, no depth limit: its leaves are the feature cells, its predictions their means."""
    rows = _v1(spark, sf_dir).withColumns({"_id": F.col("rid"), "_t": F.col("treated").cast("double"), "_y": F.col("l_extendedprice")})
    rows, xs = forest.with_cells(rows, ["l_tax", "l_linenumber"])
    means = rows.join(forest.arm_table(rows, xs, trees=1, unit_weights=True), xs)
    return (means.groupBy("l_tax", "l_linenumber").agg(rnd(F.max("_mu0"), 4).alias("mu0"), rnd(F.max("_mu1"), 4).alias("mu1"), F.count(F.lit(1)).alias("n"),
                                                       F.countDistinct("treated").alias("arms")).filter("arms = 2").drop("arms"))


# EST7 / EST8 / HTE5 -------------------------------------------------------------------------------

_FOLD = sql_uniform("rid", "42", "'fold'")


@query("est7_dml_saturated", sql=f"""WITH {SQL_V1R},
f AS (SELECT *, CAST(floor({_FOLD} * 3) AS INTEGER) AS fold FROM v1r),
fc AS (SELECT fold, l_linestatus, l_linenumber, sum(l_extendedprice) AS sy, sum(treated) AS st, count(*) AS n FROM f GROUP BY 1, 2, 3),
tc AS (SELECT l_linestatus, l_linenumber, sum(sy) AS tot_y, sum(st) AS tot_t, sum(n) AS tot_n FROM fc GROUP BY 1, 2),
nu AS (SELECT fc.fold, fc.l_linestatus, fc.l_linenumber, (tot_y - sy) / (tot_n - n) AS m, (tot_t - st) / (tot_n - n) AS e
  FROM fc JOIN tc ON fc.l_linestatus = tc.l_linestatus AND fc.l_linenumber = tc.l_linenumber),
r AS (SELECT l_extendedprice - m AS yt, treated - e AS tt FROM f JOIN nu ON f.fold = nu.fold
  AND f.l_linestatus = nu.l_linestatus AND f.l_linenumber = nu.l_linenumber),
th AS (SELECT sum(tt * yt) / sum(tt * tt) AS theta, sum(tt * tt) AS stt, count(*) AS n FROM r),
se AS (SELECT sqrt(sum(tt * tt * (yt - theta * tt) * (yt - theta * tt)) / (stt * stt) * n / (n - 1)) AS se
  FROM r, th GROUP BY stt, n)
SELECT 'LinearDML (saturated)' AS method, n, {sql_rnd('theta', 4)} AS estimate, {sql_rnd('se', 4)} AS std_error FROM th, se""")
def est7_dml_saturated(spark, sf_dir):
    """EST7 LinearDML, 3-fold md5 cross-fitting, cell-mean nuisances, constant effect, HC1 SE."""
    e = cells.dml_cells(_v1(spark, sf_dir), "treated", "l_extendedprice", CELLS, "rid")
    return e.select(F.lit("LinearDML (saturated)").alias("method"), "n", rnd("estimate", 4).alias("estimate"), rnd("std_error", 4).alias("std_error"))


@query("est7_dml_rf")
def est7_dml_rf(spark, sf_dir):
    """EST7 LinearDML with random-forest nuisances and linear effect modifiers (rows-only)."""
    return O.linear_dml(_v1(spark, sf_dir), "treated", "l_extendedprice", ["l_quantity", "l_tax"], "rid",
                        nuisance="rf", modifiers=["l_quantity"])


@query("est8_causal_forest")
def est8_causal_forest(spark, sf_dir):
    """EST8 honest causal forest: ATE of CATE(x) with its interval (rows-only)."""
    scored, _ = O.causal_forest(_v1(spark, sf_dir), "treated", "l_extendedprice", ["l_quantity", "l_tax"], "rid")
    return O.causal_ate(scored)


@query("hte5_importances")
def hte5_importances(spark, sf_dir):
    """HTE5 ranked forest feature importances (rows-only)."""
    _, imp = O.causal_forest(_v1(spark, sf_dir), "treated", "l_extendedprice", ["l_quantity", "l_tax"], "rid")
    return hte.ranked_importances(imp)


# EST11 --------------------------------------------------------------------------------------------

@query("est11_effect_by_quarter", sql=f"""WITH {SQL_V1},
p AS (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, * FROM v1),
c AS (SELECT period, treated, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) * count(*) AS ss
  FROM p GROUP BY 1, 2),
s AS (SELECT period, sum(n) AS n, max(CASE WHEN treated = 1 THEN m END) - max(CASE WHEN treated = 0 THEN m END) AS est,
  sqrt(sum(ss) / (sum(n) - 2) * sum(1.0 / n)) AS se, count(*) AS arms FROM c GROUP BY period)
SELECT period, {sql_rnd('est', 4)} AS ATE, {sql_rnd('se', 4)} AS std_error, CAST(n AS BIGINT) AS n FROM s
WHERE n >= 20 AND arms = 2""")
def est11_effect_by_quarter(spark, sf_dir):
    """EST11 effect per quarter of l_shipdate in one grouped Gram aggregate."""
    v = _v1(spark, sf_dir).withColumn("period", F.to_date(F.date_trunc("quarter", "l_shipdate")))
    e = O.effect_by_period(v, "treated", "l_extendedprice", [], "period")
    return e.select("period", rnd("ATE", 4).alias("ATE"), rnd("std_error", 4).alias("std_error"), "n")


# EST12 / REF1 / REF2 ------------------------------------------------------------------------------

_V7 = """v7 AS (SELECT o_orderkey, o_totalprice, CAST(coalesce(o_orderpriority = '1-URGENT', false) AS INTEGER) AS t
  FROM orders)"""


def _v7(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_totalprice",
                    F.coalesce(F.col("o_orderpriority") == "1-URGENT", F.lit(False)).cast("int").alias("t"))


_B = 50
_SEED = sql_row_seed("o_orderkey", "42")
_W = sql_poisson1(sql_stream_u("s", "c.a0"))


@query("est12_bootstrap", sql=f"""WITH {_V7},
c AS {sql_replicate_values(_B, 1)},
w AS (SELECT c.rep, x.t, x.o_totalprice AS y, {_W} AS w FROM (SELECT *, {_SEED} AS s FROM v7) x, c),
e AS (SELECT rep, sum(w * t * y) / sum(w * t) - sum(w * (1 - t) * y) / sum(w * (1 - t)) AS est FROM w GROUP BY rep),
pt AS (SELECT avg(CASE WHEN t = 1 THEN o_totalprice END) - avg(CASE WHEN t = 0 THEN o_totalprice END) AS p FROM v7)
SELECT {sql_rnd('(SELECT p FROM pt)', 4)} AS estimate, {sql_rnd('avg(est)', 4)} AS boot_mean,
  {sql_rnd('stddev_samp(est)', 4)} AS boot_se, {sql_rnd('quantile_cont(est, 0.025)', 4)} AS ci_lower,
  {sql_rnd('quantile_cont(est, 0.975)', 4)} AS ci_upper, count(*) AS replicates_ok FROM e""")
def est12_bootstrap(spark, sf_dir):
    """EST12 Poisson(1) md5 bootstrap (B=50) of the URGENT-vs-rest difference in o_totalprice."""
    b = O.bootstrap(_v7(spark, sf_dir), "t", "o_totalprice", [], "o_orderkey", replicates=_B)
    return b.select(*[rnd(c, 4).alias(c) for c in ("estimate", "boot_mean", "boot_se", "ci_lower", "ci_upper")],
                    "replicates_ok")


_R = 100
_N1, _N2 = sql_stream_u("s", "c.a0"), sql_stream_u("s", "c.a1")


@query("ref1_random_common_cause", sql=f"""WITH {_V7},
c AS {sql_replicate_values(_R, 2)},
x AS (SELECT c.rep, t, o_totalprice AS y, sqrt(-2.0 * ln(1.0 - {_N1})) * cos(2.0 * pi() * {_N2}) AS z
  FROM (SELECT *, {_SEED} AS s FROM v7) v, c),
cv AS (SELECT rep, covar_pop(t, t) AS tt, covar_pop(z, z) AS zz, covar_pop(t, z) AS tz, covar_pop(t, y) AS ty,
  covar_pop(z, y) AS zy FROM x GROUP BY rep),
e AS (SELECT (zz * ty - tz * zy) / (tt * zz - tz * tz) AS est FROM cv),
pt AS (SELECT avg(CASE WHEN t = 1 THEN o_totalprice END) - avg(CASE WHEN t = 0 THEN o_totalprice END) AS p FROM v7)
SELECT {sql_rnd('(SELECT p FROM pt)', 4)} AS original_effect, {sql_rnd('avg(est)', 4)} AS new_effect,
  {sql_rnd('stddev_samp(est)', 4)} AS new_sd, count(*) AS replicates,
  {sql_rnd('abs((SELECT p FROM pt) - avg(est)) / stddev_samp(est)', 4)} AS z,
  abs((SELECT p FROM pt) - avg(est)) / stddev_samp(est) < 1.959963984540054 AS passed FROM e""")
def ref1_random_common_cause(spark, sf_dir):
    """REF1 random common cause (100 replicates of an md5 Box-Muller normal covariate)."""
    _, s = refute.random_common_cause(_v7(spark, sf_dir), "t", "o_totalprice", [], "o_orderkey", replicates=_R)
    return s.select(rnd("original_effect", 4).alias("original_effect"), rnd("new_effect", 4).alias("new_effect"),
                    rnd("new_sd", 4).alias("new_sd"), "replicates", rnd("z", 4).alias("z"), "passed")


@query("ref1_random_common_cause_full")
def ref1_random_common_cause_full(spark, sf_dir):
    """REF1 with the z-test p-value and pass flag."""
    return refute.random_common_cause(_v7(spark, sf_dir), "t", "o_totalprice", [], "o_orderkey", replicates=_R)[1]


_K1 = sql_stream_u("s", "c.a1")


@query("ref2_placebo", sql=f"""WITH {_V7},
c AS {sql_replicate_values(_R, 3)},
x AS (SELECT c.rep, o_orderkey, t, o_totalprice AS y,
  row_number() OVER (PARTITION BY c.rep ORDER BY {_K1}, o_orderkey) AS r1, sum(t) OVER (PARTITION BY c.rep) AS n1
  FROM (SELECT *, {_SEED} AS s FROM v7) v, c),
p AS (SELECT rep, y, CAST(r1 <= n1 AS INTEGER) AS pt FROM x),
e AS (SELECT rep, avg(CASE WHEN pt = 1 THEN y END) - avg(CASE WHEN pt = 0 THEN y END) AS est FROM p GROUP BY rep),
pt AS (SELECT avg(CASE WHEN t = 1 THEN o_totalprice END) - avg(CASE WHEN t = 0 THEN o_totalprice END) AS p FROM v7)
SELECT {sql_rnd('(SELECT p FROM pt)', 4)} AS original_effect, {sql_rnd('avg(est)', 4)} AS new_effect,
  {sql_rnd('stddev_samp(est)', 4)} AS new_sd, count(*) AS replicates, {sql_rnd('abs(avg(est)) / stddev_samp(est)', 4)} AS z,
  abs(avg(est)) / stddev_samp(est) < 1.959963984540054 AS passed FROM e""")
def ref2_placebo(spark, sf_dir):
    """REF2 placebo (permuted) treatment, 100 replicates."""
    _, s = refute.placebo_treatment(_v7(spark, sf_dir), "t", "o_totalprice", [], "o_orderkey", replicates=_R)
    return s.select(rnd("original_effect", 4).alias("original_effect"), rnd("new_effect", 4).alias("new_effect"),
                    rnd("new_sd", 4).alias("new_sd"), "replicates", rnd("z", 4).alias("z"), "passed")


# REF4 / ARC2 --------------------------------------------------------------------------------------

_BAL = """b AS (SELECT CAST(coalesce(o.o_orderpriority = '1-URGENT', false) AS INTEGER) AS t, c.c_acctbal, c.c_nationkey
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


def _welch_sql(src: str, tcol: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS covariate, avg(CASE WHEN {tcol} = 1 THEN {c} END) AS m1,
  avg(CASE WHEN {tcol} = 0 THEN {c} END) AS m0, var_samp(CASE WHEN {tcol} = 1 THEN {c} END) AS v1,
  var_samp(CASE WHEN {tcol} = 0 THEN {c} END) AS v0, count(CASE WHEN {tcol} = 1 THEN {c} END) AS n1,
  count(CASE WHEN {tcol} = 0 THEN {c} END) AS n0 FROM {src}""")
    return f"""s AS ({' UNION ALL '.join(parts)})
SELECT covariate, {sql_rnd('m1', 4)} AS mean_treated, {sql_rnd('m0', 4)} AS mean_control, {sql_rnd('m1 - m0', 4)} AS diff,
  {sql_rnd('(m1 - m0) / sqrt(v1 / n1 + v0 / n0)', 6)} AS t_stat,
  {sql_rnd('(v1 / n1 + v0 / n0) * (v1 / n1 + v0 / n0) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v0 / n0) * (v0 / n0) / (n0 - 1))', 4)} AS dof,
  {sql_rnd('(m1 - m0) / sqrt((v1 + v0) / 2)', 6)} AS smd, n1 AS n_treated, n0 AS n_control FROM s"""


def _welch_cols(df):
    return df.select("covariate", rnd("mean_treated", 4).alias("mean_treated"),
                     rnd("mean_control", 4).alias("mean_control"), rnd("diff", 4).alias("diff"),
                     rnd("t_stat", 6).alias("t_stat"), rnd("dof", 4).alias("dof"), rnd("smd", 6).alias("smd"),
                     "n_treated", "n_control")


@query("ref4_balance", sql=f"WITH {_BAL}, " + _welch_sql("b", "t", ["c_acctbal", "c_nationkey"]))
def ref4_balance(spark, sf_dir):
    """REF4 covariate balance of customer attributes between URGENT and other orders."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey).select(
        F.coalesce(F.col("o_orderpriority") == "1-URGENT", F.lit(False)).cast("int").alias("t"), "c_acctbal", "c_nationkey")
    return _welch_cols(O.welch_table(j, "t", ["c_acctbal", "c_nationkey"]))


@query("arc2_ab_test", sql="""WITH a AS (SELECT CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS t, o_totalprice
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')), """ + _welch_sql("a", "t", ["o_totalprice"]))
def arc2_ab_test(spark, sf_dir):
    """ARC2 A/B difference in means with Welch's t (URGENT vs LOW)."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    return _welch_cols(O.ab_test(o, "o_orderpriority", "o_totalprice", "1-URGENT", "5-LOW"))




@query("est11_iptw_by_quarter", sql=f"""WITH {SQL_V1},
p AS (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, * FROM v1),
e AS (SELECT *, avg(treated) OVER (PARTITION BY period, l_linestatus, l_linenumber) AS e FROM p),
a AS (SELECT period, treated * l_extendedprice / e - (1 - treated) * l_extendedprice / (1 - e) AS a FROM e
  WHERE e > 0 AND e < 1)
SELECT period, {sql_rnd('avg(a)', 4)} AS ATE, {sql_rnd('stddev_samp(a) / sqrt(count(*))', 4)} AS std_error,
  count(*) AS n FROM a GROUP BY period HAVING count(*) >= 20""")
def est11_iptw_by_quarter(spark, sf_dir):
    """EST11 with the IPTW estimator: saturated propensity per (quarter, cell), one grouped aggregate."""
    v = _v1(spark, sf_dir).withColumn("period", F.to_date(F.date_trunc("quarter", "l_shipdate")))
    e = O.iptw_by_period(v, "treated", "l_extendedprice", CELLS, "period")
    return e.select("period", rnd("ATE", 4).alias("ATE"), rnd("std_error", 4).alias("std_error"), "n")


@query("est5_iptw_logistic")
def est5_iptw_logistic(spark, sf_dir):
    """EST5 Hajek IPTW with logistic propensities on (l_quantity, l_tax), clipped to [0.05, 0.95]."""
    p = O.with_propensity(_v1(spark, sf_dir), "treated", ["l_quantity", "l_tax"], mode="logistic")
    return O.iptw(p, "treated", "l_extendedprice", normalized=True, clip=(0.05, 0.95))


@query("est6_psm_logistic")
def est6_psm_logistic(spark, sf_dir):
    """EST6 nearest-neighbour matching on logistic propensity scores (rounded to 1e-6)."""
    p = O.with_propensity(_v1(spark, sf_dir), "treated", ["l_quantity", "l_tax"], mode="logistic")
    return O.psm(p, "treated", "l_extendedprice")


@query("ref3_unsupported_did", sql=f"""WITH {SQL_V3},
c AS (SELECT treated AS t, post AS p, avg(o_totalprice) AS m FROM v3 GROUP BY 1, 2)
SELECT 'DiD (OLS)' AS method, 'random_common_cause' AS refuter,
  {sql_rnd("max(CASE WHEN t=1 AND p=1 THEN m END) - max(CASE WHEN t=1 AND p=0 THEN m END) - max(CASE WHEN t=0 AND p=1 THEN m END) + max(CASE WHEN t=0 AND p=0 THEN m END)", 4)} AS original_effect,
  'Refutation is not available for Difference-in-Differences' AS error FROM c""")
def ref3_unsupported_did(spark, sf_dir):
    """REF3 the refutation dispatcher refuses DiD: original estimate plus the reason."""
    from .views import v3_did
    r = refute.refute_effect(v3_did(spark, sf_dir), "treated", "o_totalprice", [], "o_orderkey",
                             method="DiD (OLS)", post="post")
    return r.select("method", "refuter", rnd("original_effect", 4).alias("original_effect"), "error")


@query("ref1_dispatch_ols")
def ref1_dispatch_ols(spark, sf_dir):
    """REF1 through the dispatcher for an OLS effect (supported): p-value and pass flag."""
    return refute.refute_effect(_v7(spark, sf_dir), "t", "o_totalprice", [], "o_orderkey", method="OLS",
                                refuter="placebo", replicates=_R)


@query("snk2_scored_roundtrip", sql=f"""WITH {_ITE}
SELECT l_orderkey, l_linenumber, l_partkey, {sql_rnd('ite', 4)} AS Estimated_ITE FROM sc""")
def snk2_scored_roundtrip(spark, sf_dir):
    """SNK2 write the table with Estimated_ITE to the shared folder (parquet) and read it back."""
    from ..session import shared_path
    from ..sources import io as IO
    s = O.t_learner_saturated(_v1(spark, sf_dir), "treated", "l_extendedprice", CELLS)
    path = IO.write_table(s.select("l_orderkey", "l_linenumber", "l_partkey", "Estimated_ITE"),
                          shared_path(spark, "snk2"))
    back = IO.read_parquet(spark, path)
    return back.select("l_orderkey", "l_linenumber", "l_partkey", rnd("Estimated_ITE", 4).alias("Estimated_ITE"))


@query("est11_dml_by_quarter", sql=f"""WITH {SQL_V1R},
f AS (SELECT *, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period,
  CAST(floor({_FOLD} * 3) AS INTEGER) AS fold FROM v1r),
fc AS (SELECT fold, period, l_linestatus, l_linenumber, sum(l_extendedprice) AS sy, sum(treated) AS st, count(*) AS n
  FROM f GROUP BY 1, 2, 3, 4),
tc AS (SELECT period, l_linestatus, l_linenumber, sum(sy) AS tot_y, sum(st) AS tot_t, sum(n) AS tot_n FROM fc GROUP BY 1, 2, 3),
ft AS (SELECT fold, sum(sy) AS fy, sum(st) AS fts, sum(n) AS fn FROM fc GROUP BY 1),
al AS (SELECT sum(sy) AS all_y, sum(st) AS all_t, sum(n) AS all_n FROM fc),
nu AS (SELECT fc.fold, fc.period, fc.l_linestatus, fc.l_linenumber,
  CASE WHEN tot_n - n > 0 THEN (tot_y - sy) / (tot_n - n) ELSE (all_y - fy) / (all_n - fn) END AS m,
  CASE WHEN tot_n - n > 0 THEN (tot_t - st) / (tot_n - n) ELSE (all_t - fts) / (all_n - fn) END AS e
  FROM fc JOIN tc ON fc.period = tc.period AND fc.l_linestatus = tc.l_linestatus AND fc.l_linenumber = tc.l_linenumber
  JOIN ft ON fc.fold = ft.fold, al),
r AS (SELECT f.period, l_extendedprice - m AS yt, treated - e AS tt FROM f JOIN nu ON f.fold = nu.fold
  AND f.period = nu.period AND f.l_linestatus = nu.l_linestatus AND f.l_linenumber = nu.l_linenumber),
th AS (SELECT period, sum(tt * yt) / sum(tt * tt) AS theta, sum(tt * tt) AS stt, count(*) AS n FROM r GROUP BY period),
se AS (SELECT th.period, theta, n, sqrt(sum(tt * tt * (yt - theta * tt) * (yt - theta * tt)) / (stt * stt) * n / (n - 1)) AS se
  FROM r JOIN th ON r.period = th.period GROUP BY th.period, theta, stt, n)
SELECT period, {sql_rnd('theta', 4)} AS ATE, {sql_rnd('se', 4)} AS std_error, CAST(n AS BIGINT) AS n FROM se WHERE n >= 20""")
def est11_dml_by_quarter(spark, sf_dir):
    """EST11 with LinearDML (saturated nuisances) for every quarter in one job."""
    v = _v1(spark, sf_dir).withColumn("period", F.to_date(F.date_trunc("quarter", "l_shipdate")))
    e = O.dml_by_period(v, "treated", "l_extendedprice", CELLS, "period", "rid")
    return e.select("period", rnd("ATE", 4).alias("ATE"), rnd("std_error", 4).alias("std_error"), "n")


@query("est11_tlearner_by_quarter", sql=f"""WITH {SQL_V1},
p AS (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, * FROM v1),
cm AS (SELECT period, l_linestatus, l_linenumber, avg(CASE WHEN treated = 1 THEN l_extendedprice END)
  - avg(CASE WHEN treated = 0 THEN l_extendedprice END) AS ite FROM p GROUP BY 1, 2, 3),
sc AS (SELECT p.period, cm.ite FROM p JOIN cm ON p.period = cm.period AND p.l_linestatus = cm.l_linestatus
  AND p.l_linenumber = cm.l_linenumber WHERE cm.ite IS NOT NULL)
SELECT period, {sql_rnd('avg(ite)', 4)} AS ATE, count(*) AS n FROM sc GROUP BY period HAVING count(*) >= 20""")
def est11_tlearner_by_quarter(spark, sf_dir):
    """EST11 with the saturated T-learner for every quarter in one job."""
    v = _v1(spark, sf_dir).withColumn("period", F.to_date(F.date_trunc("quarter", "l_shipdate")))
    e = O.tlearner_by_period(v, "treated", "l_extendedprice", CELLS, "period")
    return e.select("period", rnd("ATE", 4).alias("ATE"), "n")


_W1 = sql_poisson1(sql_stream_u("s", "c.a0"))


@query("est12_bootstrap_gformula", sql=f"""WITH {SQL_V1R},
c AS {sql_replicate_values(_B, 1)},
w AS (SELECT c.rep, l_linestatus, l_linenumber, treated AS t, l_extendedprice AS y, {_W1} AS w
  FROM (SELECT *, {sql_row_seed("rid", "42")} AS s FROM v1r) x, c),
cw AS (SELECT rep, l_linestatus, l_linenumber, sum(CASE WHEN t = 1 THEN w ELSE 0 END) AS w1,
  sum(CASE WHEN t = 0 THEN w ELSE 0 END) AS w0, sum(CASE WHEN t = 1 THEN w * y ELSE 0.0 END) AS wy1,
  sum(CASE WHEN t = 0 THEN w * y ELSE 0.0 END) AS wy0 FROM w GROUP BY 1, 2, 3),
e AS (SELECT rep, sum(CASE WHEN w1 > 0 AND w0 > 0 THEN (wy1 / w1 - wy0 / w0) * (w1 + w0) END)
  / sum(CASE WHEN w1 > 0 AND w0 > 0 THEN w1 + w0 END) AS est FROM cw GROUP BY rep),
cm AS (SELECT l_linestatus, l_linenumber, count(*) AS n, avg(CASE WHEN treated = 1 THEN l_extendedprice END) AS mu1,
  avg(CASE WHEN treated = 0 THEN l_extendedprice END) AS mu0, count(*) FILTER (WHERE treated = 1) AS n1,
  count(*) FILTER (WHERE treated = 0) AS n0 FROM v1 GROUP BY 1, 2),
pt AS (SELECT sum(CASE WHEN n1 > 0 AND n0 > 0 THEN (mu1 - mu0) * n END) / sum(CASE WHEN n1 > 0 AND n0 > 0 THEN n END) AS p FROM cm)
SELECT {sql_rnd('(SELECT p FROM pt)', 4)} AS estimate, {sql_rnd('avg(est)', 4)} AS boot_mean,
  {sql_rnd('stddev_samp(est)', 4)} AS boot_se, {sql_rnd('quantile_cont(est, 0.025)', 4)} AS ci_lower,
  {sql_rnd('quantile_cont(est, 0.975)', 4)} AS ci_upper, count(*) AS replicates_ok FROM e""")
def est12_bootstrap_gformula(spark, sf_dir):
    """EST12 Poisson bootstrap (B=50) of the saturated g-formula / IPTW effect, one job."""
    b = O.bootstrap_standardization(_v1(spark, sf_dir), "treated", "l_extendedprice", CELLS, "rid", replicates=_B)
    return b.select(*[rnd(c, 4).alias(c) for c in ("estimate", "boot_mean", "boot_se", "ci_lower", "ci_upper")],
                    "replicates_ok")


# EST11 / EST12 / REF through the dispatcher ---------------------------------------------------------

_HIGH = "CAST(l_quantity > 25 AS INTEGER)"


def _quarters(spark, sf_dir):
    return _v1(spark, sf_dir).withColumns({"period": F.to_date(F.date_trunc("quarter", "l_shipdate")), "high": (F.col("l_quantity") > 25).cast("int")})


@query("est11_iptw_logistic_by_quarter", sql=f"""WITH {SQL_V1},
p AS (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, {_HIGH} AS high, treated, l_extendedprice AS y FROM v1),
e AS (SELECT *, avg(treated) OVER (PARTITION BY period, high) AS e, avg(high) OVER (PARTITION BY period) AS h FROM p),
a AS (SELECT period, treated * y / e - (1 - treated) * y / (1 - e) AS a FROM e WHERE e > 0 AND e < 1 AND h > 0 AND h < 1)
SELECT period, {sql_rnd('avg(a)', 4)} AS ATE, {sql_rnd('stddev_samp(a) / sqrt(count(*))', 4)} AS std_error, count(*) AS n FROM a GROUP BY period HAVING count(*) >= 20""")
def est11_iptw_logistic_by_quarter(spark, sf_dir):
    """EST11 IPTW with a logistic propensity for every quarter: all fits in one job a Newton step (one binary confounder: exact)."""
    e = effects.by_period(_quarters(spark, sf_dir), "iptw", "treated", "l_extendedprice", ["high"], "period", "rid")
    return e.filter("ATE IS NOT NULL").select("period", rnd("ATE", 4).alias("ATE"), rnd("std_error", 4).alias("std_error"), "n")


@query("est11_psm_by_quarter", sql=f"""WITH {SQL_V1},
p AS (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, treated AS arm, l_extendedprice AS y, l_tax, l_linenumber FROM v1),
s AS (SELECT *, sum(arm) OVER cell / CAST(count(*) OVER cell AS DOUBLE) AS score FROM p WINDOW cell AS (PARTITION BY period, l_tax, l_linenumber)),
c AS (SELECT period, arm, score, count(*) AS n, avg(y) AS m FROM s GROUP BY 1, 2, 3),
w AS (SELECT *, last_value(CASE WHEN arm = 0 THEN score END IGNORE NULLS) OVER up AS b0, last_value(CASE WHEN arm = 1 THEN score END IGNORE NULLS) OVER up AS b1,
  first_value(CASE WHEN arm = 0 THEN score END IGNORE NULLS) OVER down AS a0, first_value(CASE WHEN arm = 1 THEN score END IGNORE NULLS) OVER down AS a1
  FROM c WINDOW up AS (PARTITION BY period ORDER BY score, arm ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  down AS (PARTITION BY period ORDER BY score, arm ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
o AS (SELECT period, arm, score, n, m, CASE WHEN arm = 1 THEN b0 ELSE b1 END AS b, CASE WHEN arm = 1 THEN a0 ELSE a1 END AS a FROM w),
x AS (SELECT *, CASE WHEN b IS NULL OR (a IS NOT NULL AND a - score < score - b) THEN a ELSE b END AS to_score FROM o),
j AS (SELECT x.period, x.n, CASE WHEN x.arm = 1 THEN x.m - c.m ELSE c.m - x.m END AS d FROM x JOIN c ON c.period = x.period AND c.arm = 1 - x.arm AND c.score = x.to_score)
SELECT period, {sql_rnd('sum(n * d) / sum(n)', 4)} AS ATE, CAST(sum(n) AS BIGINT) AS n FROM j GROUP BY period HAVING sum(n) >= 20""")
def est11_psm_by_quarter(spark, sf_dir):
    """EST11 nearest-score matching within every quarter, all in one query."""
    e = effects.by_period(_quarters(spark, sf_dir), "psm_cells", "treated", "l_extendedprice", ["l_tax", "l_linenumber"], "period", "rid")
    return e.filter("ATE IS NOT NULL").select("period", rnd("ATE", 4).alias("ATE"), "n")


@query("est11_forests_by_quarter")
def est11_forests_by_quarter(spark, sf_dir):
    """EST11 forest learners for every quarter: T-learner and S-learner ATE (25 trees a quarter; rows-only)."""
    v, out = _quarters(spark, sf_dir), None
    for method in ("t_learner", "s_learner"):
        e = effects.by_period(v, method, "treated", "l_extendedprice", ["l_tax", "l_linenumber"], "period", "rid", trees=25)
        e = e.select(F.lit(method).alias("method"), "period", "ATE", "n")
        out = e if out is None else out.unionByName(e)
    return out


@query("est12_bootstrap_iptw_logistic", sql=f"""WITH {SQL_V1R},
c AS {sql_replicate_values(_B, 1)},
w AS (SELECT c.rep, {_HIGH} AS high, treated AS t, l_extendedprice AS y, {_W1} AS w FROM (SELECT *, {sql_row_seed("rid", "42")} AS s FROM v1r) x, c),
g AS (SELECT rep, high, sum(w * t) / CAST(sum(w) AS DOUBLE) AS e FROM w GROUP BY 1, 2),
d AS (SELECT w.rep, sum(w * (t * y / e - (1 - t) * y / (1 - e))) / sum(w) AS est FROM w JOIN g ON w.rep = g.rep AND w.high = g.high GROUP BY w.rep),
q AS (SELECT {_HIGH} AS high, treated AS t, l_extendedprice AS y, avg(treated) OVER (PARTITION BY {_HIGH}) AS e FROM v1),
pt AS (SELECT avg(t * y / e - (1 - t) * y / (1 - e)) AS p FROM q)
SELECT {sql_rnd('(SELECT p FROM pt)', 3)} AS estimate, {sql_rnd('avg(est)', 3)} AS boot_mean, {sql_rnd('stddev_samp(est)', 3)} AS boot_se,
  {sql_rnd('quantile_cont(est, 0.025)', 3)} AS ci_lower, {sql_rnd('quantile_cont(est, 0.975)', 3)} AS ci_upper, count(*) AS replicates_ok FROM d""")
def est12_bootstrap_iptw_logistic(spark, sf_dir):
    """EST12 50 bootstrap replicates of IPTW with a logistic propensity refitted in each: one job a Newton step for all of them."""
    v = _v1(spark, sf_dir).withColumn("high", (F.col("l_quantity") > 25).cast("int"))
    b = effects.bootstrap(v, "iptw", "treated", "l_extendedprice", ["high"], "rid", replicates=_B)
    return b.select(*[rnd(c, 3).alias(c) for c in ("estimate", "boot_mean", "boot_se", "ci_lower", "ci_upper")], "replicates_ok")


_LEVEL = "CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 ELSE 0 END"


@query("ref2_placebo_three_values", sql=f"""WITH v7 AS (SELECT o_orderkey, o_totalprice AS y, {_LEVEL} AS t FROM orders),
c AS {sql_replicate_values(_R, 3)},
n AS (SELECT count(*) FILTER (t = 2) AS n2, count(*) FILTER (t >= 1) AS n1 FROM v7),
x AS (SELECT c.rep, y, row_number() OVER (PARTITION BY c.rep ORDER BY {_K1}, o_orderkey) AS r FROM (SELECT *, {_SEED} AS s FROM v7) v, c),
p AS (SELECT rep, y, CASE WHEN r <= n2 THEN 2 WHEN r <= n1 THEN 1 ELSE 0 END AS pt FROM x, n),
e AS (SELECT rep, regr_slope(y, pt) AS est FROM p GROUP BY rep)
SELECT {sql_rnd('(SELECT regr_slope(y, t) FROM v7)', 4)} AS original_effect, {sql_rnd('avg(est)', 4)} AS new_effect,
  {sql_rnd('stddev_samp(est)', 4)} AS new_sd, count(*) AS replicates FROM e""")
def ref2_placebo_three_values(spark, sf_dir):
    """REF2 placebo of a treatment with three values, each as often in every replicate as in truth."""
    level = F.when(F.col("o_orderpriority") == "1-URGENT", 2).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", level.alias("t"))
    _, s = refute.placebo_treatment(o, "t", "o_totalprice", [], "o_orderkey", replicates=_R)
    return s.select(*[rnd(c, 4).alias(c) for c in ("original_effect", "new_effect", "new_sd")], "replicates")


@query("ref2_placebo_iptw", sql=f"""WITH v7 AS (SELECT o_orderkey, o_totalprice AS y, CAST(coalesce(o_orderpriority = '1-URGENT', false) AS INTEGER) AS t, o_orderstatus AS g FROM orders),
c AS {sql_replicate_values(_R, 3)},
x AS (SELECT c.rep, y, g, row_number() OVER (PARTITION BY c.rep ORDER BY {_K1}, o_orderkey) AS r, sum(t) OVER (PARTITION BY c.rep) AS n1
  FROM (SELECT *, {_SEED} AS s FROM v7) v, c),
p AS (SELECT rep, g, y, CAST(r <= n1 AS INTEGER) AS t FROM x),
e AS (SELECT *, avg(t) OVER (PARTITION BY rep, g) AS e FROM p),
a AS (SELECT rep, avg(t * y / e - (1 - t) * y / (1 - e)) AS est FROM e WHERE e > 0 AND e < 1 GROUP BY rep),
o AS (SELECT t, y, avg(t) OVER (PARTITION BY g) AS e FROM v7)
SELECT 'iptw_cells' AS method, {sql_rnd('(SELECT avg(t * y / e - (1 - t) * y / (1 - e)) FROM o WHERE e > 0 AND e < 1)', 3)} AS original_effect,
  {sql_rnd('avg(est)', 3)} AS new_effect, abs(avg(est)) / stddev_samp(est) < 1.959963984540054 AS passed FROM a""")
def ref2_placebo_iptw(spark, sf_dir):
    """REF2 placebo of IPTW with cell propensities: 100 replicates re-estimated by the chosen method in one job."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.coalesce(F.col("o_orderpriority") == "1-URGENT", F.lit(False)).cast("int").alias("t"))
    r = refute.refute_effect(o, "t", "o_totalprice", ["o_orderstatus"], "o_orderkey", method="iptw_cells", refuter="placebo", replicates=_R)
    return r.select("method", rnd("original_effect", 3).alias("original_effect"), rnd("new_effect", 3).alias("new_effect"), "passed")


@query("ref1_common_cause_psm")
def ref1_common_cause_psm(spark, sf_dir):
    """REF1 random common cause for matching on cells: 50 replicates in one job (rows-only)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.coalesce(F.col("o_orderpriority") == "1-URGENT", F.lit(False)).cast("int").alias("t"))
    return refute.refute_effect(o, "t", "o_totalprice", ["o_orderstatus"], "o_orderkey", method="psm_cells", replicates=50)
