"""Column-expression helpers shared by the operators.

All randomness in the library is *deterministic and partition independent*:
a uniform draw is a function of (row id, seed, replicate) through md5, so the
same rows produce the same draws under any partitioning, and the DuckDB
oracle can reproduce them bit for bit.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO52 = 4503599627370496.0


def rnd(c: Column | str, digits: int) -> Column:
    """Round half up with plain IEEE arithmetic: floor(x * 10^d + 0.5) / 10^d.

    Written identically in the oracle SQL (``sql_rnd``) so both engines apply
    the same floating-point operations to the same value.
    """
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def sql_rnd(expr: str, digits: int) -> str:
    return f"(floor(({expr}) * 1e{digits} + 0.5) / 1e{digits})"


def _key(*parts: Column | str) -> Column:
    cols = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.concat_ws("|", *cols)


def uniform(*parts: Column | str) -> Column:
    """U[0,1) from the first 52 bits of md5(concat_ws('|', parts...)), exact in a double."""
    h = F.substring(F.md5(_key(*parts)), 1, 13)
    return F.conv(h, 16, 10).cast("double") / F.lit(TWO52)


def sql_uniform(*parts: str) -> str:
    inner = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {inner})), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def poisson1_cdf() -> list[float]:
    """Cumulative Poisson(1) probabilities P(K<=k) for k = 0, 1, ... until a double holds no more."""
    out, acc, k = [], 0.0, 0
    while True:
        acc += math.exp(-1.0) / math.factorial(k)
        if acc >= 1.0 or (out and acc <= out[-1]):
            return out
        out.append(acc)
        k += 1


def poisson1(u: Column) -> Column:
    """Poisson(1) draw by inverse CDF of a uniform column."""
    cdf = poisson1_cdf()
    expr = F.lit(len(cdf))
    for k in reversed(range(len(cdf))):
        expr = F.when(u < F.lit(cdf[k]), F.lit(k)).otherwise(expr)
    return expr


def sql_poisson1(u: str) -> str:
    cdf = poisson1_cdf()
    arms = " ".join(f"WHEN {u} < {repr(p)} THEN {k}" for k, p in enumerate(cdf))
    return f"(CASE {arms} ELSE {len(cdf)} END)"


def std_normal(u1: Column, u2: Column) -> Column:
    """Box-Muller standard normal from two uniforms (u1 shifted away from 0)."""
    a = F.lit(1.0) - u1
    return F.sqrt(F.lit(-2.0) * F.log(a)) * F.cos(F.lit(2.0 * math.pi) * u2)


def null_safe_ne(c: Column, value) -> Column:
    """pandas ``!=``: a null compares unequal, so the row is kept."""
    return ~c.eqNullSafe(F.lit(value))


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Replicate streams ------------------------------------------------------------------------------
# Fixed values of a combined multiplicative generator: two moduli and their multipliers.
STREAMS = ((2147483563, 40014), (2147483399, 40692))
LOW_BITS = 1 << 31
SPREAD_FROM = 20  # draws a row from which rows are dealt out to all tasks before they are copied


def stream_consts(replicates: int, per_rep: int = 1) -> list[list[tuple[int, int]]]:
    """a^k mod m of both generators for the ``per_rep`` draws of every replicate r = 1..replicates (k = (r-1)*per_rep + j + 1)."""
    return [[tuple(pow(a, (r - 1) * per_rep + j + 1, m) for m, a in STREAMS) for j in range(per_rep)]
            for r in range(1, replicates + 1)]


def row_seed(*parts: Column | str) -> Column:
    """Per-row stream seed from 64 bits of md5(parts): a seed of either generator, about 2^62 values, in one long."""
    h = F.md5(_key(*parts))
    a, b = [F.pmod(F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long"), F.lit(m - 1)) + F.lit(1) for k, (m, _) in enumerate(STREAMS)]
    return a * F.lit(LOW_BITS) + b


def sql_row_seed(*parts: str) -> str:
    inner = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    a, b = [f"(CAST(('0x' || substr(md5(concat_ws('|', {inner})), {8 * k + 1}, 8)) AS BIGINT) % {m - 1} + 1)" for k, (m, _) in enumerate(STREAMS)]
    return f"({a} * {LOW_BITS} + {b})"


def explode_replicates(df, seed_col: Column, replicates: int, per_rep: int = 1, rep_name: str = "_rep",
                       u_prefix: str = "_u"):
    """Replicate every row ``replicates`` times with ``per_rep`` uniforms each.

    A uniform is the difference of the k-th elements x = seed * a^k mod m of the row's two streams
    (k = (r-1) * per_rep + j + 1), modulo m - 1, over m, so a row costs one md5 however many replicates it feeds and
    the draws stay partition independent and exactly reproducible in SQL.

    The seed is computed in a projection *below* the ``posexplode`` of the constant
    array.  Catalyst would otherwise move that md5 projection above the ``Generate`` (or
    inline it into a lambda) and hash every exploded row; marking the projection
    non-deterministic (a ``rand() >= 0`` guard that is always true) pins it in place.
    Later draws of a replicate follow from x_{k+j} = x_k * a^j mod m."""
    first = F.array(*[F.struct(*[F.lit(c).cast("long").alias(n) for n, c in zip("ab", cs[0], strict=True)]) for cs in stream_consts(replicates, per_rep)])
    pinned = F.when(F.rand(0) >= F.lit(0.0), seed_col.cast("long")).otherwise(seed_col.cast("long"))
    x = df.select("*", pinned.alias("_seed"))
    if replicates * per_rep >= SPREAD_FROM:  # the work is the copies': give every core rows, however few files they lie in
        spark = df.sparkSession
        x = x.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "_seed")
    x = x.select("*", F.posexplode(first).alias("_pos", "_c"))
    m1, m2 = STREAMS[0][0], STREAMS[1][0]
    x1 = F.pmod(F.shiftright("_seed", 31) * F.col("_c.a"), F.lit(m1))
    x2 = F.pmod(F.col("_seed").bitwiseAND(F.lit(LOW_BITS - 1)) * F.col("_c.b"), F.lit(m2))
    us = []
    for j in range(per_rep):
        a, b = [v if j == 0 else F.pmod(v * F.lit(pow(mult, j, m)).cast("long"), F.lit(m)) for v, (m, mult) in zip((x1, x2), STREAMS, strict=True)]
        z = F.pmod(a - b, F.lit(m1 - 1))
        us.append((F.when(z == 0, F.lit(m1 - 1)).otherwise(z).cast("double") / F.lit(float(m1))).alias(f"{u_prefix}{j}"))
    return x.select(*[c for c in df.columns], (F.col("_pos") + 1).cast("int").alias(rep_name), *us)


def sql_replicate_values(replicates: int, per_rep: int = 1) -> str:
    """VALUES table (rep, a0, b0, a1, b1, ...) of the replicate constants for the oracle SQL."""
    rows = ", ".join("(" + ", ".join(str(v) for v in [r + 1, *[x for c in cs for x in c]]) + ")" for r, cs in enumerate(stream_consts(replicates, per_rep)))
    cols = ", ".join(["rep"] + [f"{n}{j}" for j in range(per_rep) for n in "ab"])
    return f"(SELECT * FROM (VALUES {rows}) AS c({cols}))"


def sql_stream_u(seed_expr: str, a_col: str) -> str:
    """Uniform of a seed and the constants ``a_col`` (and its b) of :func:`sql_replicate_values`."""
    (m1, _), (m2, _) = STREAMS
    b_col = re.sub(r"a(\d+)$", r"b\1", a_col)
    x = f"(((({seed_expr}) // {LOW_BITS}) * {a_col}) % {m1} - ((({seed_expr}) % {LOW_BITS}) * {b_col}) % {m2})"
    z = f"(({x} % {m1 - 1} + {m1 - 1}) % {m1 - 1})"
    return f"(CAST(CASE WHEN {z} = 0 THEN {m1 - 1} ELSE {z} END AS DOUBLE) / CAST({m1} AS DOUBLE))"


def one_row(agg_df) -> dict:
    """Collect a one-row aggregate (fitted statistics: a bounded result) as a dict.

    Statistics used in several expressions are turned into literals this way: Spark does not
    reuse a struct-valued scalar sub-query referenced through several fields, so each
    reference would re-run the aggregate."""
    rows = agg_df.limit(2).collect()
    return rows[0].asDict(recursive=True) if rows else {}


def dlit(v) -> Column:
    """Double literal (null-safe)."""
    return F.lit(None).cast("double") if v is None else F.lit(float(v))


# Quantiles --------------------------------------------------------------------------------------
BAND_ROWS = 5_000       # values of a band that are brought to the driver for the last step
BAND_ACCURACY = 2_000   # accuracy of the bounds that narrow a band; it only sets the number of passes


def exact_quantiles(df, cols, probs) -> dict:
    """{column: [quantile or None]}: exact quantiles with linear interpolation, at every size.

    Each quantile needs one or two order statistics.  A pass brackets all of those that lie in one band of values between
    approximate percentiles, and counts the rows at each of these values and in the gaps around them, which says exactly where
    every order statistic lies.  The gaps leave out the values themselves, so every pass narrows the band, also where it holds two
    frequent values only; this goes on until a band holds few rows or one value, and those few values are read.  Every pass is two aggregates
    over all columns (one digest a band); no column is sorted or held by a task."""
    cols, probs = list(cols), [float(p) for p in probs]
    if not cols:
        return {}

    def value(c):
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), x)

    def inside(c, lo, hi):
        x = value(c)
        return F.when((x >= lo) & (x <= hi), x)
    first = one_row(df.agg(*[F.count(value(c)).alias(f"n{i}") for i, c in enumerate(cols)],
                           *[F.min(value(c)).alias(f"lo{i}") for i, c in enumerate(cols)],
                           *[F.max(value(c)).alias(f"hi{i}") for i, c in enumerate(cols)]))
    n = {c: int(first[f"n{i}"] or 0) for i, c in enumerate(cols)}
    bands, known = [], {}  # bands: (column, lo, hi, rows below lo, rows in [lo, hi], ranks wanted); known: (column, rank) -> value
    for i, c in enumerate(cols):
        if n[c]:
            ranks = {r for p in probs for r in (math.floor(p * (n[c] - 1)), math.ceil(p * (n[c] - 1)))}
            bands.append((c, first[f"lo{i}"], first[f"hi{i}"], 0, n[c], sorted(ranks)))
    few = []
    while bands:
        known.update({(c, k): lo for c, lo, hi, _, _, ranks in bands if lo == hi for k in ranks})
        bands = [b for b in bands if b[1] != b[2]]
        few += [b for b in bands if b[4] <= BAND_ROWS]
        bands = [b for b in bands if b[4] > BAND_ROWS]
        if not bands:
            break
        bounds = one_row(df.agg(*[F.percentile_approx(inside(c, lo, hi), _brackets([(k - below) / (rows - 1) for k in ranks]), BAND_ACCURACY).alias(f"q{j}")
                                  for j, (c, lo, hi, below, rows, ranks) in enumerate(bands)]))
        each = [F.struct(F.lit(j).alias("band"), inside(c, lo, hi).alias("x")) for j, (c, lo, hi, *_) in enumerate(bands)]
        part, x = F.lit(0), F.col("x")  # part 2i: between values i - 1 and i; part 2i + 1: at value i
        for j in range(len(bands)):
            at = sum((F.when(x > v, 2).when(x == v, 1).otherwise(0) for v in sorted(set(bounds[f"q{j}"]))), F.lit(0))
            part = F.when(F.col("band") == j, at).otherwise(part)
        found = (df.select(F.explode(F.array(*each)).alias("s")).select("s.band", "s.x").filter("x IS NOT NULL").groupBy("band", part.alias("part"))
                 .agg(F.count(F.lit(1)).alias("rows"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())  # a few rows a band
        narrow = []
        for j, (c, _, _, below, _, ranks) in enumerate(bands):
            for r in sorted((r for r in found if r["band"] == j), key=lambda r: r["part"]):
                mine = [k for k in ranks if below <= k < below + r["rows"]]
                if mine:
                    narrow.append((c, r["lo"], r["hi"], below, r["rows"], mine))
                below += r["rows"]
        bands = narrow
    if few:
        rows = one_row(df.agg(*[F.sort_array(F.collect_list(inside(c, lo, hi))).alias(f"v{j}") for j, (c, lo, hi, *_) in enumerate(few)]))
        known.update({(c, k): rows[f"v{j}"][k - below] for j, (c, _, _, below, _, ranks) in enumerate(few) for k in ranks})
    return {c: [_interpolated(known, c, p * (n[c] - 1)) if n[c] else None for p in probs] for c in cols}


def _brackets(at: list[float]) -> list[float]:
    """Ends of the intervals around the given shares of a band, those that meet joined to one."""
    ends: list[float] = []
    for r in at:
        lo, hi = max(0.0, r - 2 / BAND_ACCURACY), min(1.0, r + 2 / BAND_ACCURACY)
        if ends and lo <= ends[-1]:
            ends[-1] = hi
        else:
            ends += [lo, hi]
    return ends


def _interpolated(known: dict, c: str, position: float) -> float:
    low, high = math.floor(position), math.ceil(position)
    a, b = known[c, low], known[c, high]
    return a if a == b or low == high else (high - position) * a + (position - low) * b


def grouped_quantiles(df, keys, col_name: str, probs, name: str = "q"):
    """keys, ``name`` (array): exact quantiles with linear interpolation in every group, at every size.

    Value counts are laid out by key and value over range partitions and written; a running count inside
    each partition, on top of the counts of the partitions before it, ranks the values.  A group may
    span any number of partitions, so none has to fit one task."""
    from pyspark.sql import Window

    from ..session import written
    keys, probs = list(keys), [float(p) for p in probs]
    x = F.col(col_name).cast("double")
    counts = df.select(*keys, x.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    laid = written(counts.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()), "ranked")
    per = laid.groupBy("_p", *keys).agg(F.sum("_c").alias("_s"))  # a row per group and partition it spans
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_p", *keys, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"), F.sum("_s").over(Window.partitionBy(*keys)).alias("_n"))
    on = F.col("a._p") == F.col("b._p")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    inside = Window.partitionBy("_p", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (laid.alias("a").join(per.alias("b"), on).select("a._p", *[f"a.{k}" for k in keys], "_v", "_c", "_off", "_n")
              .withColumn("_upto", F.col("_off") + F.sum("_c").over(inside)))
    aggs, out = [], []
    for j, p in enumerate(probs):
        position = F.lit(p) * (F.col("_n") - 1)
        aggs += [F.min(F.when(F.col("_upto") > F.floor(position), F.col("_v"))).alias(f"_a{j}"),
                 F.min(F.when(F.col("_upto") > F.ceil(position), F.col("_v"))).alias(f"_b{j}")]
        a, b = F.col(f"_a{j}"), F.col(f"_b{j}")
        out.append(F.when(a == b, a).otherwise((F.ceil(position) - position) * a + (position - F.floor(position)) * b))
    return ranked.groupBy(*keys, "_n").agg(*aggs).select(*keys, F.array(*out).alias(name))
