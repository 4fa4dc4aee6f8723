"""Fixed result schemas and small builders."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

EFFECT_SCHEMA = T.StructType([
    T.StructField("method", T.StringType()),
    T.StructField("treatment", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("estimate", T.DoubleType()),
    T.StructField("std_error", T.DoubleType()),
    T.StructField("stat", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()),
    T.StructField("ci_lower", T.DoubleType()),
    T.StructField("ci_upper", T.DoubleType()),
    T.StructField("odds_ratio", T.DoubleType()),
    T.StructField("risk_diff", T.DoubleType()),
    T.StructField("rd_lower", T.DoubleType()),
    T.StructField("rd_upper", T.DoubleType()),
    T.StructField("error", T.StringType()),
])

COEF_SCHEMA_FIELDS = [
    T.StructField("term", T.StringType()),
    T.StructField("estimate", T.DoubleType()),
    T.StructField("std_error", T.DoubleType()),
    T.StructField("stat", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()),
    T.StructField("ci_lower", T.DoubleType()),
    T.StructField("ci_upper", T.DoubleType()),
    T.StructField("n", T.LongType()),
    T.StructField("dof", T.DoubleType()),
]

IMPACT_SCHEMA = T.StructType([
    T.StructField("method", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("ate", T.DoubleType()),
    T.StructField("ate_lower", T.DoubleType()),
    T.StructField("ate_upper", T.DoubleType()),
    T.StructField("cum", T.DoubleType()),
    T.StructField("cum_lower", T.DoubleType()),
    T.StructField("cum_upper", T.DoubleType()),
    T.StructField("rel", T.DoubleType()),
    T.StructField("rel_lower", T.DoubleType()),
    T.StructField("rel_upper", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()),
    T.StructField("alpha", T.DoubleType()),
    T.StructField("significant", T.BooleanType()),
    T.StructField("error", T.StringType()),
])


def _clean(v):
    if v is None:
        return None
    if isinstance(v, float) and not math.isfinite(v):
        return None
    return v


def effect_row(**kw) -> dict:
    row = {f.name: None for f in EFFECT_SCHEMA.fields}
    for k, v in kw.items():
        if k not in row:
            raise KeyError(k)
        if isinstance(v, (int,)) and k != "n" and not isinstance(v, bool):
            v = float(v)
        row[k] = _clean(v)
    if row["n"] is not None:
        row["n"] = int(row["n"])
    return row


def effect_df(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[f.name] for f in EFFECT_SCHEMA.fields) for r in rows],
                                 EFFECT_SCHEMA)


def error_effect(spark: SparkSession, method: str, treatment: str, outcome: str, msg: str) -> DataFrame:
    return effect_df(spark, [effect_row(method=method, treatment=treatment, outcome=outcome, error=msg)])
