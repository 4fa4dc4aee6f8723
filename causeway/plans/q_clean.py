"""Registered queries: cleaning / preparation (PRE1-PRE18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd, sql_rnd, sql_uniform
from ..operators import clean as C
from .registry import query
from .views import table

# PRE1 ---------------------------------------------------------------------------------------------

_BOOL_SQL = """SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END AS string_bool,
  CASE WHEN o_orderstatus = 'F' THEN 't' ELSE 'f' END AS short_bool,
  CASE WHEN o_orderstatus = 'F' THEN '1.0' WHEN o_orderstatus = 'O' THEN '0' ELSE 'TRUE' END AS mixed_bool,
  CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' THEN 'T' ELSE 'F' END AS null_bool,
  o_orderpriority AS not_bool, o_totalprice > 100000 AS real_bool FROM orders"""


def _bool_input(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    st = F.col("o_orderstatus")
    return o.select(
        "o_orderkey",
        F.when(st == "F", "True").otherwise("False").alias("string_bool"),
        F.when(st == "F", "t").otherwise("f").alias("short_bool"),
        F.when(st == "F", "1.0").when(st == "O", "0").otherwise("TRUE").alias("mixed_bool"),
        F.when(st == "P", None).when(st == "F", "T").otherwise("F").alias("null_bool"),
        F.col("o_orderpriority").alias("not_bool"),
        (F.col("o_totalprice") > 100000).alias("real_bool"))


@query("pre1_bool_to_int", sql=f"""WITH t AS ({_BOOL_SQL})
SELECT o_orderkey, CAST(upper(string_bool) IN ('TRUE', 'T', '1', '1.0') AS INTEGER) AS string_bool,
  CAST(upper(short_bool) IN ('TRUE', 'T', '1', '1.0') AS INTEGER) AS short_bool,
  CAST(upper(mixed_bool) IN ('TRUE', 'T', '1', '1.0') AS INTEGER) AS mixed_bool,
  null_bool, not_bool, CAST(real_bool AS INTEGER) AS real_bool FROM t""")
def pre1_bool_to_int(spark, sf_dir):
    """PRE1 boolean detection: string columns of boolean tokens -> int; a column with a null stays."""
    return C.convert_bool_to_int(_bool_input(spark, sf_dir))


# PRE2 / PRE3 --------------------------------------------------------------------------------------

_CUST = """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, c_nationkey FROM customer"""


def _cust(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
                    F.when(F.col("c_mktsegment") == "BUILDING", None).otherwise(F.col("c_mktsegment"))
                    .alias("c_mktsegment"), "c_nationkey")


@query("pre2_impute_mean", sql=f"""WITH t AS ({_CUST})
SELECT c_custkey, {sql_rnd('coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM t))', 4)} AS c_acctbal FROM t""")
def pre2_impute_mean(spark, sf_dir):
    """PRE2 mean imputation of c_acctbal (negatives nulled)."""
    d = C.impute_numeric(_cust(spark, sf_dir), ["c_acctbal"], "Mean")
    return d.select("c_custkey", rnd("c_acctbal", 4).alias("c_acctbal"))


@query("pre2_impute_median", sql=f"""WITH t AS ({_CUST})
SELECT c_custkey, {sql_rnd('coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM t))', 4)} AS c_acctbal
FROM t""")
def pre2_impute_median(spark, sf_dir):
    """PRE2 median imputation (exact, linear interpolation)."""
    d = C.impute_numeric(_cust(spark, sf_dir), ["c_acctbal"], "Median")
    return d.select("c_custkey", rnd("c_acctbal", 4).alias("c_acctbal"))


@query("pre3_impute_mode", sql=f"""WITH t AS ({_CUST}),
m AS (SELECT c_mktsegment AS v FROM t WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment
      ORDER BY count(*) DESC, c_mktsegment LIMIT 1)
SELECT c_custkey, coalesce(c_mktsegment, (SELECT v FROM m)) AS c_mktsegment FROM t""")
def pre3_impute_mode(spark, sf_dir):
    """PRE3 mode imputation (smallest value on ties)."""
    d = C.impute_categorical(_cust(spark, sf_dir), ["c_mktsegment"], "Mode")
    return d.select("c_custkey", "c_mktsegment")


@query("pre3_impute_missing", sql=f"""WITH t AS ({_CUST})
SELECT c_custkey, coalesce(c_mktsegment, 'Missing') AS c_mktsegment FROM t""")
def pre3_impute_missing(spark, sf_dir):
    """PRE3 literal "Missing" imputation."""
    d = C.impute_categorical(_cust(spark, sf_dir), ["c_mktsegment"], "Missing")
    return d.select("c_custkey", "c_mktsegment")


# PRE4 / PRE5 / PRE6 -------------------------------------------------------------------------------

@query("pre4_winsorize", sql=f"""WITH q AS (SELECT quantile_cont(o_totalprice, 0.05) AS lo,
  quantile_cont(o_totalprice, 0.95) AS hi FROM orders)
SELECT o_orderkey, {sql_rnd('least(greatest(o_totalprice, lo), hi)', 4)} AS o_totalprice FROM orders, q""")
def pre4_winsorize(spark, sf_dir):
    """PRE4 winsorize o_totalprice at 5 % per tail."""
    d = C.winsorize(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], 0.05)
    return d.select("o_orderkey", rnd("o_totalprice", 4).alias("o_totalprice"))


@query("pre5_log1p", sql=f"""SELECT c_custkey, {sql_rnd('ln(1 + CAST(c_nationkey AS DOUBLE))', 8)} AS c_nationkey,
  {sql_rnd('c_acctbal', 8)} AS c_acctbal FROM customer""")
def pre5_log1p(spark, sf_dir):
    """PRE5 log1p of c_nationkey; c_acctbal has negatives, so it is left as is."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    d = C.log_transform(c, ["c_nationkey", "c_acctbal"])
    return d.select("c_custkey", rnd("c_nationkey", 8).alias("c_nationkey"), rnd("c_acctbal", 8).alias("c_acctbal"))


@query("pre6_standardize", sql=f"""WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM customer)
SELECT c_custkey, {sql_rnd('(c_acctbal - m) / sd', 6)} AS c_acctbal FROM customer, s""")
def pre6_standardize(spark, sf_dir):
    """PRE6 z-score with the population standard deviation."""
    d = C.standardize(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return d.select("c_custkey", rnd("c_acctbal", 6).alias("c_acctbal"))


# PRE7 / PRE8 --------------------------------------------------------------------------------------

@query("pre7_bucket_cut", sql="""WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
e AS (SELECT lo - (hi - lo) * 0.001 AS e0, lo + 1.0 * ((hi - lo) / 4.0) AS e1, lo + 2.0 * ((hi - lo) / 4.0) AS e2,
  lo + 3.0 * ((hi - lo) / 4.0) AS e3, hi AS e4 FROM s)
SELECT l_orderkey, l_linenumber, l_quantity, CAST((e0 < l_quantity)::INT + (e1 < l_quantity)::INT
  + (e2 < l_quantity)::INT + (e3 < l_quantity)::INT + (e4 < l_quantity)::INT AS INTEGER) AS qty_bin_idx
FROM lineitem, e""")
def pre7_bucket_cut(spark, sf_dir):
    """PRE7 equal-width 4-bin cut of l_quantity (bin index compared; labels unit-tested)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return C.bucket_equal_width(li, "l_quantity", 4, "qty_bin").select("l_orderkey", "l_linenumber", "l_quantity",
                                                                       "qty_bin_idx")


@query("pre8_bucket_qcut", sql="""WITH e AS (SELECT list_sort(list_distinct(quantile_cont(CAST(l_linenumber AS DOUBLE),
  [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber = e[1] THEN 1
  ELSE len(list_filter(e, lambda x: x < l_linenumber)) END AS INTEGER) AS line_bin_idx FROM lineitem, e""")
def pre8_bucket_qcut(spark, sf_dir):
    """PRE8 equal-frequency 5-bin qcut of l_linenumber (duplicate edges dropped)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return C.bucket_quantile(li, "l_linenumber", 5, "line_bin").select("l_orderkey", "l_linenumber", "line_bin_idx")


# PRE9 ---------------------------------------------------------------------------------------------

_ORD_NULL = "SELECT o_orderkey, o_totalprice, nullif(o_orderstatus, 'P') AS o_orderstatus FROM orders"


def _ord_null(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_totalprice",
                    F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


@query("pre9_override", sql=f"""WITH t AS ({_ORD_NULL})
SELECT o_orderkey, CASE WHEN o_orderstatus IS DISTINCT FROM 'F' THEN 0.0 ELSE o_totalprice END AS o_totalprice,
  o_orderstatus FROM t""")
def pre9_override(spark, sf_dir):
    """PRE9 set o_totalprice = 0 where o_orderstatus != 'F' (null status counts as !=)."""
    new, _ = C.override(_ord_null(spark, sf_dir), "o_totalprice", 0.0, "o_orderstatus", "!=", "F")
    return new


@query("pre9_override_report", sql=f"""WITH t AS ({_ORD_NULL})
SELECT count(*) FILTER (WHERE o_orderstatus IS DISTINCT FROM 'F') AS rows_matched,
  count(*) FILTER (WHERE o_orderstatus IS DISTINCT FROM 'F' AND o_totalprice IS DISTINCT FROM 0.0) AS rows_changed
FROM t""")
def pre9_override_report(spark, sf_dir):
    """PRE9 rows matched / changed by the override."""
    _, rep = C.override(_ord_null(spark, sf_dir), "o_totalprice", 0.0, "o_orderstatus", "!=", "F")
    return rep


# PRE10 / PRE11 ------------------------------------------------------------------------------------

_FO = "SELECT o_orderkey, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS urgent FROM orders"
_U = sql_uniform("o_orderkey", "42")


def _urgent(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"))


@query("pre10_oversample", sql=f"""WITH t AS ({_FO}),
c AS (SELECT urgent AS s, count(*) AS n FROM t WHERE urgent IS NOT NULL GROUP BY 1),
mn AS (SELECT s, n FROM c ORDER BY n, s LIMIT 1), mx AS (SELECT s, n FROM c ORDER BY n DESC, s DESC LIMIT 1),
ranked AS (SELECT t.*, row_number() OVER (ORDER BY {_U}, o_orderkey) - 1 AS pos FROM t WHERE urgent = (SELECT s FROM mn)),
slots AS (SELECT CAST(floor({sql_uniform('range', '42', "'slot'")} * (SELECT n FROM mn)) AS BIGINT) AS pos
  FROM range((SELECT n FROM mx)))
SELECT o_orderkey, urgent FROM t WHERE urgent = (SELECT s FROM mx)
UNION ALL SELECT r.o_orderkey, r.urgent FROM slots JOIN ranked r ON slots.pos = r.pos""")
def pre10_oversample(spark, sf_dir):
    """PRE10 over-sample the minority of urgent / other orders to the majority size (md5 draws, seed 42)."""
    return C.oversample_minority(_urgent(spark, sf_dir), "urgent", "o_orderkey", 42)


@query("pre11_downsample", sql=f"""WITH t AS ({_FO}),
c AS (SELECT urgent AS s, count(*) AS n FROM t WHERE urgent IS NOT NULL GROUP BY 1),
mn AS (SELECT s, n FROM c ORDER BY n, s LIMIT 1), mx AS (SELECT s, n FROM c ORDER BY n DESC, s DESC LIMIT 1),
ranked AS (SELECT t.*, row_number() OVER (ORDER BY {_U}, o_orderkey) AS rk FROM t WHERE urgent = (SELECT s FROM mx))
SELECT o_orderkey, urgent FROM t WHERE urgent = (SELECT s FROM mn)
UNION ALL SELECT o_orderkey, urgent FROM ranked WHERE rk <= (SELECT n FROM mn)""")
def pre11_downsample(spark, sf_dir):
    """PRE11 down-sample the majority of urgent / other orders without replacement (md5 order, seed 42)."""
    return C.downsample_majority(_urgent(spark, sf_dir), "urgent", "o_orderkey", 42)


# PRE12 / PRE13 ------------------------------------------------------------------------------------

@query("pre12_filter", sql=f"""WITH t AS ({_ORD_NULL})
SELECT o_orderkey, o_orderstatus FROM t WHERE o_totalprice > 30000 AND o_orderstatus IS DISTINCT FROM 'O'""")
def pre12_filter(spark, sf_dir):
    """PRE12 chained filters: o_totalprice > 30000 then o_orderstatus != 'O' (nulls kept)."""
    d = C.apply_filter(_ord_null(spark, sf_dir), "o_totalprice", ">", 30000)
    return C.apply_filter(d, "o_orderstatus", "!=", "O").select("o_orderkey", "o_orderstatus")


@query("pre12_filter_contains", sql="""SELECT o_orderkey, o_orderpriority FROM orders
WHERE coalesce(regexp_matches(o_orderpriority, '^[12]-'), false)""")
def pre12_filter_contains(spark, sf_dir):
    """PRE12 regex 'contains' filter on o_orderpriority."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return C.apply_filter(o, "o_orderpriority", "contains", "^[12]-")


@query("pre12_filter_report", sql=f"""WITH t AS ({_ORD_NULL})
SELECT count(*) AS rows_before, count(*) FILTER (WHERE o_orderstatus IS DISTINCT FROM 'O') AS rows_after FROM t""")
def pre12_filter_report(spark, sf_dir):
    """PRE12 row counts before/after a != filter."""
    return C.filter_report(_ord_null(spark, sf_dir), "o_orderstatus", "!=", "O")


@query("pre13_dedupe_subset", sql="""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def pre13_dedupe_subset(spark, sf_dir):
    """PRE13 keep the first order (by o_orderkey) of each customer."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return C.drop_duplicates(o, ["o_custkey"], "o_orderkey")


@query("pre13_dedupe_all", sql="SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def pre13_dedupe_all(spark, sf_dir):
    """PRE13 full-row dedupe."""
    return C.drop_duplicates(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


# PRE14 / PRE15 ------------------------------------------------------------------------------------

@query("pre14_one_hot", sql="""SELECT o_orderkey,
  CAST(o_orderpriority = '2-HIGH' AS INTEGER) AS "o_orderpriority_2-HIGH",
  CAST(o_orderpriority = '3-MEDIUM' AS INTEGER) AS "o_orderpriority_3-MEDIUM",
  CAST(o_orderpriority = '4-NOT SPECIFIED' AS INTEGER) AS "o_orderpriority_4-NOT SPECIFIED",
  CAST(o_orderpriority = '5-LOW' AS INTEGER) AS "o_orderpriority_5-LOW",
  coalesce(CAST(nullif(o_orderstatus, 'P') = 'O' AS INTEGER), 0) AS o_orderstatus_O FROM orders""")
def pre14_one_hot(spark, sf_dir):
    """PRE14 one-hot with drop_first (null status 'P'->null gives all zeros)."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority",
        F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return C.one_hot(o, ["o_orderpriority", "o_orderstatus"])


@query("pre15_encode_one_vs_rest", sql="""SELECT o_orderkey,
  CAST(coalesce(o_orderpriority = '1-URGENT', false) AS INTEGER) AS treated FROM orders""")
def pre15_encode_one_vs_rest(spark, sf_dir):
    """PRE15 one-vs-rest treatment encoding (UI form)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return C.encode_treatment(o, "o_orderpriority", "1-URGENT", None, "treated").select("o_orderkey", "treated")


@query("pre15_encode_pair", sql="""SELECT o_orderkey, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS treated
FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""")
def pre15_encode_pair(spark, sf_dir):
    """PRE15 pair encoding (control 5-LOW -> 0, treat 1-URGENT -> 1, other rows dropped)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return C.encode_treatment(o, "o_orderpriority", "1-URGENT", "5-LOW", "treated").select("o_orderkey", "treated")


# PRE16 --------------------------------------------------------------------------------------------

RECIPE = [
    {"op": "impute_numeric", "cols": ["c_acctbal"], "method": "Mean"},
    {"op": "impute_categorical", "cols": ["c_mktsegment"], "method": "Mode"},
    {"op": "winsorize", "cols": ["c_acctbal"], "p": 0.05},
    {"op": "standardize", "cols": ["c_acctbal"]},
    {"op": "filter", "col": "c_mktsegment", "op_": "!=", "val": "AUTOMOBILE"},
    {"op": "bucket", "col": "c_acctbal", "n_bins": 4, "method": "cut", "new_col": "bal_bin"},
]


@query("pre16_recipe", sql=f"""WITH t AS ({_CUST}),
m AS (SELECT c_mktsegment AS v FROM t WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
a AS (SELECT c_custkey, coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM t)) AS x,
  coalesce(c_mktsegment, (SELECT v FROM m)) AS seg FROM t),
q AS (SELECT quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM a),
b AS (SELECT c_custkey, least(greatest(x, lo), hi) AS x, seg FROM a, q),
s AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM b),
z AS (SELECT c_custkey, (x - m) / sd AS x, seg FROM b, s WHERE seg IS DISTINCT FROM 'AUTOMOBILE'),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM z),
e AS (SELECT lo - (hi - lo) * 0.001 AS e0, lo + 1.0 * ((hi - lo) / 4.0) AS e1, lo + 2.0 * ((hi - lo) / 4.0) AS e2,
  lo + 3.0 * ((hi - lo) / 4.0) AS e3, hi AS e4 FROM r)
SELECT c_custkey, {sql_rnd('x', 6)} AS c_acctbal, seg AS c_mktsegment,
  CAST((e0 < x)::INT + (e1 < x)::INT + (e2 < x)::INT + (e3 < x)::INT + (e4 < x)::INT AS INTEGER) AS bal_bin_idx
FROM z, e""")
def pre16_recipe(spark, sf_dir):
    """PRE16 recipe replay: impute -> winsorize -> standardize -> filter -> cut."""
    d = C.apply_recipe(_cust(spark, sf_dir), RECIPE)
    return d.select("c_custkey", rnd("c_acctbal", 6).alias("c_acctbal"), "c_mktsegment", "bal_bin_idx")


# PRE17 / PRE18 ------------------------------------------------------------------------------------

@query("pre17_coerce", sql="""SELECT TRY_CAST(regexp_extract(props, '"k": (-?[0-9]+)', 1) AS DOUBLE) AS k,
  CAST(ts AS DATE) AS date FROM events
WHERE TRY_CAST(regexp_extract(props, '"k": (-?[0-9]+)', 1) AS DOUBLE) IS NOT NULL""")
def pre17_coerce(spark, sf_dir):
    """PRE17 to_numeric(errors='coerce') of a JSON-embedded number + date parse + dropna."""
    e = table(spark, sf_dir, "events").select(
        F.regexp_extract("props", '"k": (-?[0-9]+)', 1).alias("k"), F.col("ts").alias("date"))
    return C.coerce(e, ["k"], ["date"])


@query("pre18_cutoff", sql="""SELECT event_id, CAST(ts AS DATE) AS date FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-21'""")
def pre18_cutoff(spark, sf_dir):
    """PRE18 historical cutoff before 2024-01-21."""
    e = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("date"))
    return C.historical_cutoff(e, "date", "2024-01-21")
