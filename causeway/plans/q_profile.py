"""Registered queries: profiling / data quality (PRF1-PRF14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd, sql_rnd
from ..operators import profile as P
from .registry import query
from .views import table

LI_NUM = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORD_CAT = ["o_orderstatus", "o_orderpriority"]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _li_with_flag(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(*LI_NUM, (F.col("l_discount") >= 0.05).cast("int").alias("treated"))


_DESCRIBE_SQL = "WITH t AS (SELECT *, CAST(l_discount >= 0.05 AS INTEGER) AS treated FROM lineitem)\n" + _union([
    f"""SELECT '{c}' AS column_name, count({c}) AS count, {sql_rnd(f'avg({c})', 2)} AS mean,
  {sql_rnd(f'stddev_samp({c})', 2)} AS std, {sql_rnd(f'min({c})', 2)} AS "min",
  {sql_rnd(f'quantile_cont({c}, 0.25)', 2)} AS p25, {sql_rnd(f'quantile_cont({c}, 0.5)', 2)} AS p50,
  {sql_rnd(f'quantile_cont({c}, 0.75)', 2)} AS p75, {sql_rnd(f'max({c})', 2)} AS "max" FROM t"""
    for c in LI_NUM])


@query("prf1_describe", sql=_DESCRIBE_SQL)
def prf1_describe(spark, sf_dir):
    """PRF1 numeric describe of lineitem (the 0/1 column 'treated' is skipped as categorical)."""
    return P.describe(_li_with_flag(spark, sf_dir), LI_NUM + ["treated"])


@query("prf2_categorical_frequency", sql=_union([
    f"""SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count,
  {sql_rnd(f'count(*) * 100.0 / sum(count(*)) OVER ()', 2)} AS percent
  FROM orders WHERE {c} IS NOT NULL GROUP BY {c}""" for c in ORD_CAT]))
def prf2_categorical_frequency(spark, sf_dir):
    """PRF2 value counts and percent of non-null values for orders' categorical columns."""
    return P.categorical_frequency(table(spark, sf_dir, "orders"), ORD_CAT)


_CUST_NULLS = """SELECT c_custkey, c_name, c_nationkey,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer"""


def _cust_nulls(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_name", "c_nationkey",
                    F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
                    F.when(F.col("c_mktsegment") == "BUILDING", None).otherwise(F.col("c_mktsegment"))
                    .alias("c_mktsegment"))


_CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("prf3_missing", sql=f"WITH t AS ({_CUST_NULLS})\n" + _union([
    f"""SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS missing,
  {sql_rnd(f'(count(*) - count({c})) * 100.0 / count(*)', 2)} AS percent FROM t""" for c in _CUST_COLS]))
def prf3_missing(spark, sf_dir):
    """PRF3 null count and percent per column (nulls planted with nullif on customer)."""
    return P.missing_report(_cust_nulls(spark, sf_dir))


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LI_NULLS = """SELECT l_quantity, l_extendedprice, l_discount,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax END AS l_tax FROM lineitem"""


def _li_nulls(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_quantity", "l_extendedprice", "l_discount",
                     F.when(F.col("l_linenumber") == 1, None).otherwise(F.col("l_tax")).alias("l_tax"))


def _corr_sql():
    parts = []
    for i, a in enumerate(_CORR_COLS):
        for j, b in enumerate(_CORR_COLS):
            if i == j:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST(1.0 AS DOUBLE) AS r")
            else:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {sql_rnd(f'corr({a}, {b})', 6)} AS r FROM t")
    return f"WITH t AS ({_LI_NULLS})\n" + _union(parts)


@query("prf4_correlation", sql=_corr_sql())
def prf4_correlation(spark, sf_dir):
    """PRF4 pairwise-complete Pearson matrix (l_tax nulled on line 1)."""
    return P.correlation_matrix(_li_nulls(spark, sf_dir), _CORR_COLS)


def _high_sql():
    parts = []
    for i, a in enumerate(_CORR_COLS):
        for j, b in enumerate(_CORR_COLS):
            if i < j:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {sql_rnd(f'corr({a}, {b})', 2)} AS r FROM t")
    return f"WITH t AS ({_LI_NULLS}), p AS (" + _union(parts) + ") SELECT * FROM p WHERE abs(r) > 0.5"


@query("prf5_high_correlations", sql=_high_sql())
def prf5_high_correlations(spark, sf_dir):
    """PRF5 pairs with |round(r,2)| > 0.5."""
    return P.high_correlations(_li_nulls(spark, sf_dir), _CORR_COLS)


@query("prf6_skewness", sql=_union([
    f"SELECT '{c}' AS column_name, {sql_rnd(f'skewness({c})', 2)} AS skew FROM lineitem" for c in LI_NUM]))
def prf6_skewness(spark, sf_dir):
    """PRF6 bias-corrected skewness (DuckDB's skewness is the corrected G1)."""
    return P.skewness(table(spark, sf_dir, "lineitem"), LI_NUM)


@query("prf7_duplicates", sql="""SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) AS duplicates
FROM lineitem""")
def prf7_duplicates(spark, sf_dir):
    """PRF7 duplicate full rows of lineitem."""
    return P.duplicate_rows(table(spark, sf_dir, "lineitem"))


@query("prf8_shape", sql="""SELECT 'rows' AS metric, count(*) AS value FROM lineitem
UNION ALL SELECT 'columns', 11 UNION ALL SELECT 'numeric_columns', 8 UNION ALL SELECT 'categorical_columns', 2
UNION ALL SELECT 'datetime_columns', 1 UNION ALL SELECT 'bool_columns', 0""")
def prf8_shape(spark, sf_dir):
    """PRF8 rows, columns and column counts per type family of lineitem."""
    return P.shape(table(spark, sf_dir, "lineitem"))


_TOP_COLS = ["o_orderstatus", "o_orderpriority"]


@query("prf9_top_values", sql=_union([
    f"""SELECT * FROM (SELECT '{c}' AS column_name, (SELECT count(DISTINCT {c}) FROM orders) AS nunique,
  CAST({c} AS VARCHAR) AS top, count(*) AS top_count FROM orders WHERE {c} IS NOT NULL GROUP BY {c}
  ORDER BY count(*) DESC, CAST({c} AS VARCHAR) ASC LIMIT 1)""" for c in _TOP_COLS]))
def prf9_top_values(spark, sf_dir):
    """PRF9 nunique and most frequent value (smallest on ties) of categorical columns."""
    return P.top_values(table(spark, sf_dir, "orders"), _TOP_COLS)


def _card_sql():
    num = {"o_orderkey", "o_custkey", "o_totalprice"}
    parts = []
    for c, kind in [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "categorical"),
                    ("o_totalprice", "numeric"), ("o_orderpriority", "categorical")]:
        if c in num:
            parts.append(f"""SELECT '{c}' AS column_name, '{kind}' AS dtype, count(*) - count({c}) AS nulls,
  avg(CAST({c} AS DOUBLE)) AS mean, CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max",
  CAST(NULL AS BIGINT) AS nunique, CAST(NULL AS VARCHAR) AS "values" FROM orders""")
        else:
            parts.append(f"""SELECT '{c}' AS column_name, '{kind}' AS dtype, count(*) - count({c}) AS nulls,
  CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS "min", CAST(NULL AS DOUBLE) AS "max",
  count(DISTINCT {c}) AS nunique,
  CASE WHEN count(DISTINCT {c}) < 10 THEN (SELECT string_agg(v, ', ' ORDER BY v) FROM
    (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM orders WHERE {c} IS NOT NULL)) END AS "values" FROM orders""")
    return "SELECT column_name, dtype, nulls, " \
           f"{sql_rnd('mean', 4)} AS mean, \"min\", \"max\", nunique, \"values\" FROM (" + _union(parts) + ")"


@query("prf10_column_card", sql=_card_sql())
def prf10_column_card(spark, sf_dir):
    """PRF10 per-column card (dtype, nulls, numeric stats or distinct values)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                              "o_orderpriority")
    c = P.column_card(o)
    return c.select("column_name", "dtype", "nulls", rnd("mean", 4).alias("mean"), "min", "max", "nunique",
                    "values")


@query("prf11_column_sample", sql=_union([
    f"""SELECT * FROM (SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS rank,
  CAST({c} AS VARCHAR) AS value FROM orders WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 3)"""
    for c in ["o_orderstatus", "o_orderpriority"]]))
def prf11_column_sample(spark, sf_dir):
    """PRF11 first 3 non-null values per column by o_orderkey (distributed top-k)."""
    return P.column_sample(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey")


def _readiness_sql():
    """The rules of ``profile.READINESS_RULES`` on the orders table, one row per family."""
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    num = ["o_orderkey", "o_custkey", "o_totalprice"]
    nu = _union([f"SELECT '{c}' AS c, count(DISTINCT {c}) AS nu FROM orders" for c in cols])
    miss = " + ".join(f"(count(*) - count({c}))" for c in cols)
    flat = ", ".join(f"CASE WHEN coalesce(stddev_samp({c}), 0) = 0 THEN 'zero variance: column {c}' END" for c in num)
    names = ", ".join(f"'{c}'" for c in num)
    rules = [  # family, status, condition, message (SQL)
        ("Universal (Base)", "red", "n < 15", "n || ' rows are too few for any estimate (at least 15)'"),
        ("Universal (Base)", "red", "2 * missing > n * 6 OR n = 0", "'more than half of all cells are null (' || missing || ')'"),
        ("Universal (Base)", "yellow", "missing > 0 AND 2 * missing <= n * 6", "missing || ' null cells: impute them first'"),
        ("Universal (Base)", "red", "flat <> ''", "flat"),
        ("Difference-in-Differences", "yellow", "NOT any2", "'no two-valued column for group or period'"),
        ("Bayesian Time Series (CausalImpact)", "yellow", "missing > 0", "'nulls would leave gaps in the series'"),
        ("Synthetic Control (GeoLift/CausalPy)", "red", "units < 2", "'fewer than two units: one treated and one donor are needed'"),
        ("Cross-Sectional ML (DML/Meta)", "yellow", "n < 150", "'with ' || n || ' rows a forest is likely to overfit'"),
        ("Traditional Stats (OLS/Logistic)", "red", "n <= 6", "'not more rows than columns: the design is singular'"),
        ("Traditional Stats (OLS/Logistic)", "yellow", "NOT num2", "'no two-valued numeric outcome for a logistic model'"),
        ("Propensity Scores (PSM/IPTW)", "red", "NOT any2", "'no two-valued treatment column'"),
    ]
    hits = _union([f"SELECT '{f}' AS category, '{st}' AS st, {m} AS m FROM facts WHERE {c}" for f, st, c, m in rules])
    families = ", ".join(f"('{f}')" for f in dict.fromkeys(r[0] for r in rules))
    return f"""WITH nu AS ({nu}),
s AS (SELECT count(*) AS n, {miss} AS missing, concat_ws(' | ', {flat}) AS flat FROM orders),
f AS (SELECT bool_or(nu = 2) AS any2, bool_or(nu = 2 AND c IN ({names})) AS num2,
  max(CASE WHEN c IN ('o_orderstatus', 'o_orderpriority') THEN nu END) AS units FROM nu),
facts AS (SELECT * FROM s, f), hits AS ({hits}), families(category) AS (VALUES {families})
SELECT families.category, CASE WHEN bool_or(st = 'red') THEN 'red' WHEN bool_or(st = 'yellow') THEN 'yellow' ELSE 'green' END AS status,
  coalesce(string_agg(m, ' | ' ORDER BY m), '') AS messages FROM families LEFT JOIN hits USING (category) GROUP BY families.category"""


@query("prf12_readiness", sql=_readiness_sql())
def prf12_readiness(spark, sf_dir):
    """PRF12 readiness of the orders table for the seven method families."""
    return P.readiness(table(spark, sf_dir, "orders"))


@query("prf13_eligibility", sql=_union([
    f"""SELECT '{c}' AS column_name, '{k}, ' || count(DISTINCT {c}) || ' unique' AS label, true AS has_date,
  false AS has_region FROM orders""" for c, k in [("o_orderkey", "Numeric"), ("o_custkey", "Numeric"),
                                                   ("o_orderstatus", "Categorical"), ("o_totalprice", "Numeric"),
                                                   ("o_orderdate", "Categorical"),
                                                   ("o_orderpriority", "Categorical")]]))
def prf13_eligibility(spark, sf_dir):
    """PRF13 date/region flags and per-column type + distinct-count labels for orders."""
    return P.eligibility(table(spark, sf_dir, "orders"))


_BIN_VIEW = """SELECT l_linestatus, l_returnflag, CAST(l_discount >= 0.05 AS INTEGER) AS treated,
  CAST(l_returnflag = 'R' AS INTEGER) AS returned, l_linenumber FROM lineitem"""


@query("prf14_binary_columns", sql=f"WITH t AS ({_BIN_VIEW}), nu AS (" + _union([
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS nu FROM t"
    for c in ["l_linestatus", "l_returnflag", "treated", "returned", "l_linenumber"]])
    + ") SELECT column_name FROM nu WHERE nu = 2")
def prf14_binary_columns(spark, sf_dir):
    """PRF14 / EST13 columns with exactly two distinct values."""
    li = table(spark, sf_dir, "lineitem")
    t = li.select("l_linestatus", "l_returnflag", (F.col("l_discount") >= 0.05).cast("int").alias("treated"),
                  (F.col("l_returnflag") == "R").cast("int").alias("returned"), "l_linenumber")
    return P.binary_columns(t)
