"""Summaries of posterior draws (QX5, QX17, QX18): aggregates and windows over draws that are rows of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# QX5: summary of draws -------------------------------------------------------------------------------

def impact_summary(draws: DataFrame, observed: DataFrame, alpha: float = 0.05, method: str = "BSTS") -> DataFrame:
    """avg / cumulative / relative effect with posterior intervals, tail-area p and significance.

    ``observed`` = (unit, date, y).  Per (unit, chain, draw): ate_d, cum_d, rel_d; per unit:
    means and percentile bounds; p = (min(#pred_sum >= obs_sum, #pred_sum <= obs_sum) + 1) / (D + 1).
    """
    j = draws.join(observed.select("unit", "date", "y"), ["unit", "date"])
    per = j.groupBy("unit", "chain", "draw").agg(
        F.avg(F.col("y") - F.col("predicted")).alias("ate_d"), F.sum(F.col("y") - F.col("predicted")).alias("cum_d"),
        F.sum("predicted").alias("pred_sum"), F.sum("y").alias("obs_sum"))
    per = per.withColumn("rel_d", F.try_divide(F.col("cum_d"), F.col("pred_sum")))
    lo, hi = alpha / 2, 1 - alpha / 2
    q = lambda c: F.percentile(c, F.array(F.lit(lo), F.lit(hi)))
    s = per.groupBy("unit").agg(
        F.avg("ate_d").alias("ate"), q("ate_d").alias("qa"), F.avg("cum_d").alias("cum"), q("cum_d").alias("qc"),
        F.avg("rel_d").alias("rel"), q("rel_d").alias("qr"),
        F.sum((F.col("pred_sum") >= F.col("obs_sum")).cast("int")).alias("n_ge"),
        F.sum((F.col("pred_sum") <= F.col("obs_sum")).cast("int")).alias("n_le"),
        F.count(F.lit(1)).alias("D"))
    p = F.try_divide(F.least("n_ge", "n_le") + 1, F.col("D") + 1)
    return s.select(F.lit(method).alias("method"), "unit", "ate", F.col("qa")[0].alias("ate_lower"),
                    F.col("qa")[1].alias("ate_upper"), "cum", F.col("qc")[0].alias("cum_lower"),
                    F.col("qc")[1].alias("cum_upper"), (F.col("rel") * 100).alias("rel"),
                    (F.col("qr")[0] * 100).alias("rel_lower"), (F.col("qr")[1] * 100).alias("rel_upper"),
                    p.alias("p_value"), F.lit(float(alpha)).alias("alpha"), (p < alpha).alias("significant"),
                    F.lit(None).cast("string").alias("error"))


# QX17 / QX18: draw summaries ------------------------------------------------------------------------

def hdi(values: DataFrame, keys: Sequence[str], value: str, prob: float = 0.95) -> DataFrame:
    """Highest-density interval: the narrowest window of ceil(prob * n) sorted draws
    (window per key over that key's draws; ``lead`` gives the window end)."""
    w = Window.partitionBy(*keys).orderBy(value)
    n = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    v = values.join(n, list(keys)).select(*keys, value, "_n", F.row_number().over(w).alias("_r"))
    k = F.ceil(F.lit(prob) * F.col("_n")).cast("int") - 1
    # end of a window starting at rank r = value at rank r + k (self-join on rank; per key n rows)
    ends = v.select(*keys, F.col("_r").alias("_re"), F.col(value).alias("_end"))
    starts = v.select(*keys, value, "_r", (F.col("_r") + k).alias("_re"))
    j = starts.join(ends, [*keys, "_re"])
    best = j.groupBy(*keys).agg(F.min_by(F.struct(F.col(value).alias("lo"), F.col("_end").alias("hi")),
                                         F.col("_end") - F.col(value)).alias("b"))
    return best.select(*keys, F.col("b.lo").alias("hdi_lower"), F.col("b.hi").alias("hdi_upper"))


def draw_summary(draws: DataFrame, observed: DataFrame, hdi_prob: float = 0.95, direction: str = "two-sided",
                 method: str = "BayesianSC") -> DataFrame:
    """QX17/QX18: per unit, for the average and cumulative effect: posterior mean, HDI, tail p
    (two-sided 2*min(P>0, P<0); increase P(<=0); decrease P(>=0)), probability of an effect in
    the tested direction, relative lift mean(y)/mean(yhat) - 1."""
    j = draws.join(observed.select("unit", "date", "y"), ["unit", "date"])
    per = j.groupBy("unit", "chain", "draw").agg(
        F.avg(F.col("y") - F.col("predicted")).alias("avg_effect"), F.sum(F.col("y") - F.col("predicted")).alias("cum_effect"),
        F.avg("y").alias("my"), F.avg("predicted").alias("mp"))
    out = None
    for name in ("avg_effect", "cum_effect"):
        pos = F.avg((F.col(name) > 0).cast("double"))
        neg = F.avg((F.col(name) < 0).cast("double"))
        if direction == "two-sided":
            p = F.least(F.lit(1.0), 2 * F.least(pos, neg))
            prob = F.greatest(pos, neg)
        elif direction == "increase":
            p, prob = F.avg((F.col(name) <= 0).cast("double")), pos
        elif direction == "decrease":
            p, prob = F.avg((F.col(name) >= 0).cast("double")), neg
        else:
            raise ValueError(direction)
        s = per.groupBy("unit").agg(F.avg(name).alias("mean"), p.alias("p_value"), prob.alias("prob_effect"),
                                    (F.try_divide(F.avg("my"), F.avg("mp")) - 1).alias("relative_lift"))
        h = hdi(per.select("unit", name), ["unit"], name, hdi_prob)
        s = s.join(h, "unit").select(F.lit(method).alias("method"), "unit", F.lit(name).alias("metric"), "mean",
                                     "hdi_lower", "hdi_upper", "p_value", "prob_effect", "relative_lift")
        out = s if out is None else out.unionByName(s)
    return out
