"""Registered queries: difference-in-differences on V3 (orders x customer)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd, sql_rnd
from ..operators import did
from .registry import query
from .views import SQL_V3, v3_did


def _effect_cols(df, d_est=4, d_se=4):
    return df.select("method", "n", rnd("estimate", d_est).alias("estimate"),
                     rnd("std_error", d_se).alias("std_error"), rnd("stat", 6).alias("stat"))


_CELLS = f"""WITH {SQL_V3},
cells AS (SELECT treated AS t, post AS p, avg(o_totalprice) AS m, count(*) AS n,
  var_pop(o_totalprice) * count(*) AS ss FROM v3 GROUP BY treated, post),
s AS (SELECT sum(CASE WHEN t=1 AND p=1 THEN m END) - sum(CASE WHEN t=1 AND p=0 THEN m END)
  - sum(CASE WHEN t=0 AND p=1 THEN m END) + sum(CASE WHEN t=0 AND p=0 THEN m END) AS est,
  sqrt(sum(ss) / (sum(n) - 4) * sum(1.0 / n)) AS se, sum(n) AS n FROM cells)"""


@query("qx1_did_ols", sql=_CELLS + f"""
SELECT 'DiD (OLS)' AS method, CAST(n AS BIGINT) AS n, {sql_rnd('est', 4)} AS estimate,
  {sql_rnd('se', 4)} AS std_error, {sql_rnd('est / se', 6)} AS stat FROM s""")
def qx1_did_ols(spark, sf_dir):
    """QX1 DiD OLS: o_totalprice ~ BUILDING x post-1998 (Gram aggregate + solve)."""
    v = v3_did(spark, sf_dir)
    return _effect_cols(did.did_ols(v, "treated", "post", "o_totalprice"))


@query("qx1_did_ols_cov")
def qx1_did_ols_cov(spark, sf_dir):
    """QX1 with a confounder (c_acctbal): full effect row, p-value and t-based CI."""
    v = v3_did(spark, sf_dir)
    return did.did_ols(v, "treated", "post", "o_totalprice", ["c_acctbal"])


@query("qx2_did_logit", sql=f"""WITH {SQL_V3},
c AS (SELECT treated AS t, post AS p, sum(filled) AS y1, count(*) - sum(filled) AS y0 FROM v3 GROUP BY 1, 2),
s AS (SELECT
  ln(sum(CASE WHEN t=1 AND p=1 THEN y1 END) / sum(CASE WHEN t=1 AND p=1 THEN y0 END))
  - ln(sum(CASE WHEN t=1 AND p=0 THEN y1 END) / sum(CASE WHEN t=1 AND p=0 THEN y0 END))
  - ln(sum(CASE WHEN t=0 AND p=1 THEN y1 END) / sum(CASE WHEN t=0 AND p=1 THEN y0 END))
  + ln(sum(CASE WHEN t=0 AND p=0 THEN y1 END) / sum(CASE WHEN t=0 AND p=0 THEN y0 END)) AS est,
  sqrt(sum(1.0 / y1 + 1.0 / y0)) AS se, sum(y1 + y0) AS n FROM c)
SELECT 'DiD (Logit)' AS method, CAST(n AS BIGINT) AS n, {sql_rnd('est', 6)} AS estimate,
  {sql_rnd('se', 6)} AS std_error, {sql_rnd('exp(est)', 6)} AS odds_ratio FROM s""")
def qx2_did_logit(spark, sf_dir):
    """QX2 DiD logit: P(orderstatus='F') ~ BUILDING x post (IRLS); saturated closed form oracle."""
    v = v3_did(spark, sf_dir)
    e = did.did_logit(v, "treated", "post", "filled")
    return e.select("method", "n", rnd("estimate", 6).alias("estimate"), rnd("std_error", 6).alias("std_error"),
                    rnd("odds_ratio", 6).alias("odds_ratio"))


@query("qx3_did_cells", sql=f"""WITH {SQL_V3}
SELECT treated, post, {sql_rnd('avg(o_totalprice)', 4)} AS mean_outcome, count(*) AS n
FROM v3 GROUP BY treated, post""")
def qx3_did_cells(spark, sf_dir):
    """QX3 four-cell table of mean outcome and counts."""
    c = did.did_cells(v3_did(spark, sf_dir), "treated", "post", "o_totalprice")
    return c.select("treated", "post", rnd("mean_outcome", 4).alias("mean_outcome"), "n")


@query("qx3_did_summary", sql=f"""WITH {SQL_V3},
c AS (SELECT treated AS t, post AS p, avg(o_totalprice) AS m FROM v3 GROUP BY 1, 2),
s AS (SELECT max(CASE WHEN t=1 AND p=0 THEN m END) AS tp0, max(CASE WHEN t=1 AND p=1 THEN m END) AS tp1,
  max(CASE WHEN t=0 AND p=0 THEN m END) AS cp0, max(CASE WHEN t=0 AND p=1 THEN m END) AS cp1 FROM c)
SELECT {sql_rnd('tp0', 4)} AS treated_pre, {sql_rnd('tp1', 4)} AS treated_post,
  {sql_rnd('cp0', 4)} AS control_pre, {sql_rnd('cp1', 4)} AS control_post,
  {sql_rnd('tp1 - tp0', 4)} AS treated_change, {sql_rnd('cp1 - cp0', 4)} AS control_change,
  {sql_rnd('(tp1 - tp0) - (cp1 - cp0)', 4)} AS did FROM s""")
def qx3_did_summary(spark, sf_dir):
    """QX3 contrast row (pre/post means per group, changes, DiD)."""
    s = did.did_summary(v3_did(spark, sf_dir), "treated", "post", "o_totalprice")
    return s.select(*[rnd(c, 4).alias(c) for c in s.columns])


@query("hte4_triple_diff", sql=f"""WITH {SQL_V3},
x AS (SELECT *, CAST(c_acctbal > 5000 AS INTEGER) AS rich FROM v3),
c AS (SELECT treated AS t, post AS p, rich AS r, avg(o_totalprice) AS m FROM x GROUP BY 1, 2, 3),
s AS (SELECT sum(m * (CASE WHEN t=1 THEN 1 ELSE -1 END) * (CASE WHEN p=1 THEN 1 ELSE -1 END)
  * (CASE WHEN r=1 THEN 1 ELSE -1 END)) AS est FROM c)
SELECT 'rich' AS feature, {sql_rnd('est', 4)} AS estimate FROM s""")
def hte4_triple_diff(spark, sf_dir):
    """HTE4 triple difference with binary X (acctbal > 5000): equals the DDD of 8 cell means."""
    v = v3_did(spark, sf_dir).withColumn("rich", (F.col("c_acctbal") > 5000).cast("int"))
    r = did.triple_diff_scan(v, "treated", "post", "o_totalprice", ["rich"])
    return r.select("feature", rnd("estimate", 4).alias("estimate"))
