"""Sources and sinks (SRC1-SRC2, SNK1-SNK4).

Paths for written tables come from the shared checkpoint folder
(``spark.checkpoint.dir``), never from a machine-local temp directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import convert_bool_to_int


def read_csv(spark: SparkSession, path: str, bool_to_int: bool = True, schema: T.StructType | None = None) -> DataFrame:
    """SRC1: CSV with header; inferred schema unless given; boolean-like columns -> 0/1 (PRE1)."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path)
    return convert_bool_to_int(df) if bool_to_int else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def preview(df: DataFrame, order_by: str, n: int = 10) -> DataFrame:
    """SRC2: first ``n`` rows by an explicit order key (distributed top-k), datetimes as yyyy-MM-dd."""
    top = df.orderBy(order_by).limit(n)
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            cols.append(F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return top.select(*cols)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """SNK1-SNK3: write the working table / scored table / series (CSV with header or parquet)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path
