"""Causal views over the driver tables (FIXTURES.md part B).

Each view is a lazy projection/join of the parquet tables, so column pruning
and predicate push-down reach the scan.  Joins to dimension tables are left
to the optimizer (AQE turns them into broadcast joins only when the runtime
size is under ``spark.sql.autoBroadcastJoinThreshold``), because at the
target scale ``customer`` is itself billions of rows.

The matching SQL fragments (``SQL_*``) are what the DuckDB oracle uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# V1 / V2: lineitem cross-section ------------------------------------------------------------

def v1_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T = discount >= 0.05, Y = extendedprice (continuous) or returnflag = 'R' (binary)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
        (F.col("l_discount") >= 0.05).cast("int").alias("treated"),
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        (F.col("l_linestatus") == "F").cast("int").alias("status_f"),
        F.to_date("l_shipdate").alias("ship_date"),
    )


SQL_V1 = """v1 AS (SELECT *, CAST(l_discount >= 0.05 AS INTEGER) AS treated,
  CAST(l_returnflag = 'R' AS INTEGER) AS returned, CAST(l_linestatus = 'F' AS INTEGER) AS status_f,
  CAST(l_shipdate AS DATE) AS ship_date FROM lineitem)"""


# V3: orders x customer DiD ---------------------------------------------------------------------

def v3_did(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
                                              "o_orderstatus", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select("*", (F.col("c_mktsegment") == "BUILDING").cast("int").alias("treated"),
                    (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).cast("int").alias("post"),
                    (F.col("o_orderstatus") == "F").cast("int").alias("filled"))


SQL_V3 = """v3 AS (SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderdate, o.o_orderstatus,
  o.o_orderpriority, c.c_custkey, c.c_mktsegment, c.c_acctbal, c.c_nationkey,
  CAST(c.c_mktsegment = 'BUILDING' AS INTEGER) AS treated,
  CAST(o.o_orderdate >= TIMESTAMP '1998-01-01' AS INTEGER) AS post,
  CAST(o.o_orderstatus = 'F' AS INTEGER) AS filled
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


# V4: events daily panel ------------------------------------------------------------------------

def v4_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.to_date("ts").alias("date"))


SQL_V4 = """v4 AS (SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS date FROM events)"""


def v4_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long panel (unit=event_type, date, y=sum(value), n=count)."""
    return (v4_events(spark, sf_dir).groupBy(F.col("event_type").alias("unit"), "date")
            .agg(F.sum("value").alias("y"), F.count(F.lit(1)).alias("n_events")))


SQL_V4_DAILY = SQL_V4 + """, v4d AS (SELECT event_type AS unit, date, sum(value) AS y, count(*) AS n_events
  FROM v4 GROUP BY event_type, date)"""


# V5: monthly nation panel ----------------------------------------------------------------------

def v5_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select("o_orderkey", "o_totalprice", F.col("n_name").alias("unit"),
                    F.trunc(F.to_date("o_orderdate"), "month").alias("date"))


SQL_V5 = """v5 AS (SELECT o.o_orderkey, o.o_totalprice, n.n_name AS unit,
  CAST(date_trunc('month', o.o_orderdate) AS DATE) AS date
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"""


def v5_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (v5_orders(spark, sf_dir).groupBy("unit", "date")
            .agg(F.sum("o_totalprice").alias("y"), F.count(F.lit(1)).alias("n_orders")))


# V7: categorical treatment on orders -----------------------------------------------------------

def v7_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
                                                 "o_orderstatus", "o_orderdate")
