"""Permuted treatments in many replicates (REF2), without shuffling replicates x rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dlit, explode_replicates, row_seed
from ..session import written

ERRORS = 8         # standard errors around a rank's share in which its key is sought first
BRACKET = 2_000    # accuracy of the approximate quantiles that bracket a replicate's cuts where it is not found there
MOST_VALUES = 64   # treatments with more values are permuted by ranking the rows


def permuted(base: DataFrame, treatment: str, row_id: str, replicates: int, seed: int, name: str = "_placebo") -> DataFrame:
    """``base`` in every replicate (_rep) with ``name``: the treatment, permuted over the rows.

    Every row has a random key in every replicate.  Each value of the treatment, from the highest down, takes as many of the rows with the
    smallest keys (ties by id) as have it in truth: an interval of ranks.  The keys at the ends of the intervals are bracketed (:func:`_cuts`),
    so only the few rows inside the brackets are ranked.
    Treatments with more than MOST_VALUES values are permuted by joining two independent rankings over range partitions."""
    t = F.col(treatment).cast("double")
    counts = base.groupBy(t.alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("v")).limit(MOST_VALUES + 1).collect()
    rep = explode_replicates(base, row_seed(F.col(row_id), F.lit(seed)), replicates, 3)
    if len(counts) > MOST_VALUES:
        second = _ranked(rep, "_u2", row_id).select("_rep", "_rank", F.col(treatment).alias(name))
        return _ranked(rep, "_u1", row_id).join(second, ["_rep", "_rank"])
    values = [r["v"] for r in counts]
    ranks = [sum(r["n"] for r in counts[:k]) for k in range(1, len(counts))]
    if not ranks:
        return rep.withColumn(name, dlit(values[0] if values else None))
    cuts = _cuts(rep, row_id, ranks, sum(r["n"] for r in counts), replicates)
    passed = F.lit(0)
    for k in range(len(ranks)):
        cut, cut_id = F.col("_cuts")[k]["u"], F.col("_cuts")[k]["id"]
        passed = passed + F.when((F.col("_u1") > cut) | ((F.col("_u1") == cut) & (F.col(row_id) > cut_id)), 1).otherwise(0)
    placebo = F.element_at(F.array(*[F.lit(float(v)) for v in values]), passed + 1)
    return rep.join(F.broadcast(cuts), "_rep").withColumn(name, placebo).drop("_cuts")  # a row per replicate


def _cuts(rep: DataFrame, row_id: str, ranks: list[int], n: int, replicates: int) -> DataFrame:
    """(_rep, _cuts): keys and ids of the rows with the given ranks in each replicate, by (_u1, id).

    The keys are uniform, so that of rank r lies within a few standard errors of r / n, and the rows there are about the root of all.  The
    counts say whether it does in every replicate; where not (ids that repeat share their keys), approximate quantiles bracket it."""
    def ends(r):
        at = r / n
        width = ERRORS * math.sqrt(at * (1 - at) / n) + ERRORS / n
        return at - width, at + width
    low, high = zip(*[ends(r) for r in ranks], strict=True)
    low = [min(low[k:]) for k in range(len(ranks))]  # in order, like the ranks
    found = _inside(rep, row_id, ranks, [F.lit(v) for v in low], [F.lit(v) for v in high])
    right = [r["_rep"] for r in found.groupBy("_rep").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") == len(ranks)).collect()]  # a number a replicate
    if len(right) < replicates:
        left = rep.filter(~F.col("_rep").isin(right))
        width = 2 / BRACKET
        probs = [p for r in ranks for p in (max(0.0, r / n - width), min(1.0, r / n + width))]
        q = written(left.groupBy("_rep").agg(F.percentile_approx("_u1", probs, BRACKET).alias("_q")), "brackets")
        again = _inside(left.join(F.broadcast(q), "_rep"), row_id, ranks, [F.col("_q")[2 * k] for k in range(len(ranks))], [F.col("_q")[2 * k + 1] for k in range(len(ranks))])
        found = found.filter(F.col("_rep").isin(right)).unionByName(again)
    return found.groupBy("_rep").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "u", "id"))), lambda c: F.struct(c["u"].alias("u"), c["id"].alias("id"))).alias("_cuts"))


def _inside(rep: DataFrame, row_id: str, ranks: list[int], low: list, high: list) -> DataFrame:
    """(_rep, _k, u, id): the row with the k-th rank of every replicate in which it lies between ``low[k]`` and ``high[k]``, in one pass over ``rep``.

    Rows above all brackets are left out, those below or between brackets are only counted; the others are kept by key and id."""
    u, m = F.col("_u1"), len(ranks)
    known = rep.filter(u <= (F.greatest(*high) if m > 1 else high[0]))
    place = sum((F.when(u < low[k], 0).otherwise(1) for k in range(m)), F.lit(0))  # the brackets that the key has reached
    within = reduce(lambda a, b: a | b, [(u >= low[k]) & (u <= high[k]) for k in range(m)])
    mask = sum((F.when((u >= low[k]) & (u <= high[k]), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k in range(m)), F.lit(0).cast("long"))
    kept = known.select("_rep", place.alias("_place"), mask.alias("_mask"), F.when(within, u).alias("_u"), F.when(within, F.col(row_id)).alias("_id"))
    parts = written(kept.groupBy("_rep", "_place", "_mask", "_u", "_id").agg(F.count(F.lit(1)).alias("_n")), "keys")
    below = parts.groupBy("_rep").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("_place") <= k, F.col("_n"))), F.lit(0)) for k in range(m)]).alias("_below"))
    brackets = F.filter(F.sequence(F.lit(0), F.lit(m - 1)), lambda k: F.getbit("_mask", k) == 1)
    band = parts.filter("_mask > 0").select("_rep", F.explode(brackets).alias("_k"), "_u", "_id", "_n")
    upto = F.sum("_n").over(Window.partitionBy("_rep", "_k").orderBy("_u", "_id").rowsBetween(Window.unboundedPreceding, 0))
    wanted = F.element_at(F.array(*[F.lit(r).cast("long") for r in ranks]), F.col("_k") + 1)
    ranked = band.select("*", upto.alias("_upto")).join(F.broadcast(below), "_rep").withColumn("_upto", F.col("_upto") + F.col("_below")[F.col("_k")])
    return ranked.filter((F.col("_upto") >= wanted) & (F.col("_upto") - F.col("_n") < wanted)).select("_rep", "_k", F.col("_u").alias("u"), F.col("_id").alias("id"))


def _ranked(rep: DataFrame, key: str, row_id: str) -> DataFrame:
    """``rep`` with ``_rank``: the place of a row in its replicate by (key, id), over range partitions."""
    laid = written(rep.repartitionByRange("_rep", key, row_id).withColumn("_p", F.spark_partition_id()), "ranked")
    per = laid.groupBy("_rep", "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("_rep").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_rep", "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    place = F.row_number().over(Window.partitionBy("_rep", "_p").orderBy(key, row_id))
    return laid.join(per, ["_rep", "_p"]).withColumn("_rank", F.col("_off") + place).drop("_off", "_p")
