"""Cleaning and preparation operators (PRE1-PRE18) and the recipe replay.

Fitted statistics (means, medians, modes, quantiles) are Spark scalar
sub-queries, so a transform stays one lazy plan: the statistic is computed by
its own aggregate and used as a literal in the projection.  Only decisions
that change the *schema* (which string columns are boolean, which values a
one-hot column gets) collect a bounded one-row result first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import dlit, exact_quantiles, one_row, uniform
from .profile import NUMERIC, categorical_columns, numeric_columns

# PRE1 ---------------------------------------------------------------------------------------------

# The accepted spellings of a boolean (after upper-casing), and those meaning true.
BOOL_TOKENS = ["TRUE", "FALSE", "T", "F", "1", "0", "1.0", "0.0"]
TRUE_TOKENS = ["TRUE", "T", "1", "1.0"]


def convert_bool_to_int(df: DataFrame) -> DataFrame:
    """Boolean columns -> int; string columns -> 0/1 iff every value (upper-cased) is a
    boolean token and the column has no null (a null stringifies to NAN/NONE)."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    flags = {}
    if strings:
        row = df.agg(*[F.bool_and(F.coalesce(F.upper(F.col(c)).isin(BOOL_TOKENS), F.lit(False))).alias(f"b{i}")
                       for i, c in enumerate(strings)]).collect()[0]
        flags = {c: bool(row[f"b{i}"]) for i, c in enumerate(strings)}
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            out.append(c.cast("int").alias(f.name))
        elif flags.get(f.name):
            out.append(F.upper(c).isin(TRUE_TOKENS).cast("int").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


# PRE2 / PRE3 --------------------------------------------------------------------------------------

def impute_numeric(df: DataFrame, cols: Sequence[str] | None = None, method: str = "Mean",
                   value: float | None = None) -> DataFrame:
    """Fill nulls of numeric columns with Mean / Median / Zero / Custom."""
    cols = list(cols or numeric_columns(df))
    fills = {}
    if method in ("Mean", "Median"):
        if method == "Mean":
            stats = one_row(df.agg(*[F.avg(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]))
        else:
            q = exact_quantiles(df, cols, [0.5])
            stats = {f"s{i}": q[c][0] for i, c in enumerate(cols)}
        fills = {c: dlit(stats[f"s{i}"]) for i, c in enumerate(cols)}
    elif method == "Zero":
        fills = {c: F.lit(0.0) for c in cols}
    elif method == "Custom":
        fills = {c: F.lit(float(value)) for c in cols}
    else:
        raise ValueError(method)
    return df.select(*[(F.coalesce(F.col(c).cast("double"), fills[c]).alias(c) if c in fills else F.col(c))
                       for c in df.columns])


def impute_categorical(df: DataFrame, cols: Sequence[str] | None = None, method: str = "Mode",
                       value: str | None = None) -> DataFrame:
    """Fill nulls of non-numeric columns with the Mode (smallest on ties), "Missing" or a Custom value.

    The default columns are all non-numeric ones for Mode, and the string columns for a text: a date
    or boolean column cannot hold it."""
    kinds = T.DataType if method == "Mode" else T.StringType
    cols = list(cols or [c for c in df.columns if not isinstance(df.schema[c].dataType, NUMERIC) and isinstance(df.schema[c].dataType, kinds)])
    if method == "Mode":
        stats = one_row(df.agg(*[F.mode(F.col(c), True).alias(f"s{i}") for i, c in enumerate(cols)]))
        fills = {c: F.lit(stats[f"s{i}"]).cast(df.schema[c].dataType) for i, c in enumerate(cols)}
    elif method == "Missing":
        fills = {c: F.lit("Missing") for c in cols}
    elif method == "Custom":
        fills = {c: F.lit(value) for c in cols}
    else:
        raise ValueError(method)
    return df.select(*[(F.coalesce(F.col(c), fills[c]).alias(c) if c in fills else F.col(c)) for c in df.columns])


# PRE4 / PRE5 / PRE6 -------------------------------------------------------------------------------

def winsorize(df: DataFrame, cols: Sequence[str], p: float = 0.05) -> DataFrame:
    """Clip to [q(p), q(1-p)] (linear-interpolated quantiles), 0.01 <= p <= 0.25."""
    if not 0.01 <= p <= 0.25:
        raise ValueError("p must be within [0.01, 0.25]")
    q = exact_quantiles(df, cols, [p, 1 - p])
    repl = {c: F.least(F.greatest(F.col(c).cast("double"), dlit(q[c][0])), dlit(q[c][1])) for c in cols}
    return df.select(*[repl[c].alias(c) if c in repl else F.col(c) for c in df.columns])


def log_transform(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """log1p of each column; a column holding any negative value is left unchanged."""
    mins = one_row(df.agg(*[F.min(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]))
    repl = {c: (F.log1p(F.col(c).cast("double")) if (mins[f"m{i}"] is None or mins[f"m{i}"] >= 0)
                else F.col(c).cast("double")) for i, c in enumerate(cols)}
    return df.select(*[repl[c].alias(c) if c in repl else F.col(c) for c in df.columns])


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / std_pop; a zero-variance column is scaled by 1."""
    s = one_row(df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                       *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]))
    repl = {}
    for i, c in enumerate(cols):
        sd = s[f"s{i}"]
        scale = 1.0 if (sd is None or sd == 0) else sd
        repl[c] = (F.col(c).cast("double") - dlit(s[f"m{i}"])) / F.lit(float(scale))
    return df.select(*[repl[c].alias(c) if c in repl else F.col(c) for c in df.columns])


# PRE7 / PRE8 --------------------------------------------------------------------------------------

def _round_frac(x: float, precision: int) -> float:
    if not math.isfinite(x) or x == 0:
        return x
    frac, whole = math.modf(x)
    if whole == 0:
        digits = -int(math.floor(math.log10(abs(frac)))) - 1 + precision
    else:
        digits = precision
    return round(x, digits)


def _infer_precision(base: int, edges: list[float]) -> int:
    """Smallest precision >= base at which the rounded edges stay distinct (as pandas does)."""
    for p in range(base, 20):
        if len({_round_frac(e, p) for e in edges}) == len(edges):
            return p
    return base


def interval_labels(edges: list[float], precision: int, include_lowest: bool) -> list[str]:
    """Right-closed interval labels "(a, b]" formatted like pandas cut/qcut."""
    precision = _infer_precision(precision, edges)
    br = [_round_frac(e, precision) for e in edges]
    if include_lowest:
        br[0] = br[0] - 10 ** (-precision)
    return [f"({_fmt(a)}, {_fmt(b)}]" for a, b in zip(br[:-1], br[1:])]


def _fmt(x: float) -> str:
    return repr(float(x)) if not float(x).is_integer() else f"{float(x):.1f}"


def equal_width_edges(lo: Column, hi: Column, n: int) -> Column:
    """pandas cut edges: linspace(min, max, n+1) with the first edge moved down by 0.1 % of the
    range; a constant column gets edges x -/+ 0.1 % of |x| (0.001 when x == 0)."""
    rng = hi - lo
    step = rng / F.lit(float(n))
    lin = F.transform(F.sequence(F.lit(0), F.lit(n)),
                      lambda i: F.when(i == n, hi).otherwise(lo + i.cast("double") * step))
    adj = F.when(lo == F.lit(0.0), F.lit(0.001)).otherwise(F.abs(lo) * 0.001)
    adjh = F.when(hi == F.lit(0.0), F.lit(0.001)).otherwise(F.abs(hi) * 0.001)
    const = F.transform(F.sequence(F.lit(0), F.lit(n)),
                        lambda i: (lo - adj) + i.cast("double") * ((hi + adjh) - (lo - adj)) / F.lit(float(n)))
    moved = F.concat(F.array(lo - rng * 0.001), F.slice(lin, 2, n))
    return F.when(rng == 0, const).otherwise(moved)


def bucket_equal_width(df: DataFrame, col: str, n: int, new_col: str | None = None) -> DataFrame:
    """PRE7: adds ``{new_col}`` (label) and ``{new_col}_idx`` (1-based bin) like ``pd.cut(bins=n)``."""
    if not 2 <= n <= 20:
        raise ValueError("n must be within [2, 20]")
    new_col = new_col or f"{col}_binned"
    x = F.col(col).cast("double")
    st = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("s")).select(
        equal_width_edges(F.col("s.lo"), F.col("s.hi"), n).alias("e"))
    edges = one_row(st)["e"]  # n + 1 numbers
    if edges is None:
        return df.select("*", F.lit("nan").alias(new_col), F.lit(None).cast("int").alias(f"{new_col}_idx"))
    labels = interval_labels([float(v) for v in edges], 1, False)
    return _apply_edges(df, x, edges, labels, new_col, False)


def bucket_quantile(df: DataFrame, col: str, n: int, new_col: str | None = None) -> DataFrame:
    """PRE8: equal-frequency bins like ``pd.qcut(q=n, duplicates='drop')`` (right-closed, lowest
    included); duplicate edges dropped, ties never split."""
    new_col = new_col or f"{col}_binned"
    x = F.col(col).cast("double")
    probs = [i / n for i in range(n + 1)]
    edges = sorted({e for e in exact_quantiles(df, [col], probs)[col] if e is not None})  # at most n + 1 numbers
    if not edges:
        return df.select("*", F.lit("nan").alias(new_col), F.lit(None).cast("int").alias(f"{new_col}_idx"))
    labels = interval_labels([float(v) for v in edges], 3, True) if len(edges) > 1 else []
    return _apply_edges(df, x, edges, labels, new_col, True)


def _apply_edges(df, x, edges, labels, new_col, include_lowest):
    """bin = number of edges strictly below x (pandas searchsorted 'left'); with
    ``include_lowest`` the first edge itself falls in bin 1.  The fitted edges and labels are
    literals; the comparison is unrolled over them (plain codegen'd expressions)."""
    e = [F.lit(float(v)) for v in edges]
    below = reduce(lambda a, b: a + b, [(ei < x).cast("int") for ei in e])
    first, last = e[0], e[-1]
    if include_lowest:
        bin_idx = (F.when(x.isNull() | (x < first) | (x > last), F.lit(None))
                   .when(x == first, F.lit(1)).otherwise(below))
    else:
        bin_idx = F.when(x.isNull() | (x <= first) | (x > last), F.lit(None)).otherwise(below)
    bin_idx = bin_idx.cast("int")
    lab = F.lit(None).cast("string")
    for k, text in enumerate(labels, start=1):
        lab = F.when(bin_idx == k, F.lit(text)).otherwise(lab)
    label = F.coalesce(lab, F.lit("nan"))
    return df.select("*", label.alias(new_col), bin_idx.alias(f"{new_col}_idx"))


# PRE9 ---------------------------------------------------------------------------------------------

_OPS = {">": "__gt__", "<": "__lt__", "==": "__eq__", ">=": "__ge__", "<=": "__le__"}


def predicate(c: Column, op: str, val) -> Column:
    """Comparison with pandas null semantics: ``!=`` keeps nulls; ``contains`` is a regex search
    over the string form.  Where the column is null the other comparisons are null, which a filter and a
    ``when`` take as false; the bare comparison is what reaches the scan."""
    if op == "!=":
        return ~c.eqNullSafe(F.lit(val))
    if op == "contains":
        return c.cast("string").rlike(str(val))
    if op not in _OPS:
        raise ValueError(op)
    return getattr(c, _OPS[op])(F.lit(val))


def override(df: DataFrame, target: str, value, cond_col: str, op: str, val) -> tuple[DataFrame, DataFrame]:
    """Set ``target = value`` where ``cond_col op val``; returns (new_df, one-row report of rows
    matched and rows whose value actually changed)."""
    pred = predicate(F.col(cond_col), op, val)
    new = df.select(*[F.when(pred, F.lit(value)).otherwise(F.col(c)).alias(c) if c == target else F.col(c)
                      for c in df.columns])
    report = df.agg(F.count(F.when(pred, 1)).alias("rows_matched"),
                    F.count(F.when(pred & ~F.col(target).eqNullSafe(F.lit(value)), 1)).alias("rows_changed"))
    return new, report


# PRE10 / PRE11 ------------------------------------------------------------------------------------

def global_rank(df: DataFrame, order: Column, name: str = "_rank") -> DataFrame:
    """0-based dense position of every row in ``order`` without a single-partition window.

    Range-partitioned sort, checkpointed to the shared folder so the
    partitioning is fixed; per-partition row counts (one row per partition)
    give offsets that are added to the in-partition position.
    """
    s = df.withColumn("_ord", order).orderBy("_ord").checkpoint(eager=True)
    s = s.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_m0"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offs = counts.select("_pid", "_m0", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    return (s.join(F.broadcast(offs), "_pid")
            .withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long"))
            .drop("_pid", "_mid", "_m0", "_off", "_ord"))


def _two_classes(df: DataFrame, target: str):
    """[(minority, rows), (majority, rows)] of a target with two non-null classes; None if they are equal in size."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).count().orderBy(F.col("count"), F.col(target)).limit(3).collect()
    if len(counts) != 2:
        raise ValueError(f"{target} must have exactly two classes to be balanced")
    if counts[0]["count"] == counts[1]["count"]:
        return None
    return [(r[target], r["count"]) for r in counts]


def oversample_minority(df: DataFrame, target: str, row_id: str, seed: int = 42) -> DataFrame:
    """PRE10: replace the minority class by ``n_majority`` draws with replacement.

    Slot j in [0, n_maj) draws minority position floor(u(j, seed) * n_min); the
    minority rows are positioned by md5(row_id, seed) via ``global_rank`` and
    joined on that position (equi-join, no single task holds the class).
    Equal class counts return the input unchanged; any number of classes but two raises.
    """
    classes = _two_classes(df, target)
    if classes is None:
        return df
    (minority, n_min), (majority, n_maj) = classes
    spark = df.sparkSession
    mino = global_rank(df.filter(F.col(target) == minority),
                       F.struct(uniform(F.col(row_id), F.lit(seed)), F.col(row_id)), "_pos")
    slots = spark.range(n_maj).select(
        F.floor(uniform(F.col("id"), F.lit(seed), F.lit("slot")) * F.lit(float(n_min))).cast("long").alias("_pos"))
    drawn = slots.join(mino, "_pos").drop("_pos")
    return df.filter(F.col(target) == majority).unionByName(drawn)


def downsample_majority(df: DataFrame, target: str, row_id: str, seed: int = 42) -> DataFrame:
    """PRE11: keep the ``n_min`` majority rows with the smallest u = md5(row_id, seed) (ties by id).

    Exact selection without a global sort: rows below a low threshold are kept
    outright, and only the O(sqrt n) band around the n_min/n_maj quantile is
    ordered (a bounded top-k).
    """
    classes = _two_classes(df, target)
    if classes is None:
        return df
    (minority, n_min), (majority, n_maj) = classes
    u = uniform(F.col(row_id), F.lit(seed))
    maj = df.filter(F.col(target) == majority).withColumn("_u", u)
    p = n_min / n_maj
    margin = 8.0 * math.sqrt(max(n_min, 1.0)) / n_maj + 1e-12
    lo, hi = max(p - margin, 0.0), min(p + margin, 1.0 + 1e-9)
    below = maj.filter(F.col("_u") < lo)
    need = n_min - below.count()
    band = maj.filter((F.col("_u") >= lo) & (F.col("_u") < hi))
    if need < 0 or band.count() < need:  # the band missed the rank (probability ~0): rank all rows, still distributed
        kept = global_rank(maj, F.struct("_u", row_id), "_pos").filter(F.col("_pos") < n_min).drop("_pos")
    else:
        kept = below.unionByName(band.orderBy("_u", row_id).limit(need))
    return df.filter(F.col(target) == minority).unionByName(kept.drop("_u"))


# PRE12 / PRE13 / PRE14 / PRE15 --------------------------------------------------------------------

def apply_filter(df: DataFrame, col: str, op: str, val) -> DataFrame:
    """Keep rows where ``col op val`` (pandas null semantics, see ``predicate``)."""
    return df.filter(predicate(F.col(col), op, val))


def filter_report(df: DataFrame, col: str, op: str, val) -> DataFrame:
    """rows_before, rows_after of a filter in one aggregate."""
    pred = predicate(F.col(col), op, val)
    return df.agg(F.count(F.lit(1)).alias("rows_before"), F.count(F.when(pred, 1)).alias("rows_after"))


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, order_by: str | None = None) -> DataFrame:
    """All-column dedupe, or keep the first row (by ``order_by``) of each ``subset`` key.

    The subset form is an aggregate (``min_by`` of the row struct) so a hot key
    is combined map-side instead of being sorted in one task.
    """
    if not subset:
        return df.dropDuplicates()
    if order_by is None:
        raise ValueError("order_by is required to define the first row")
    others = [c for c in df.columns if c not in subset]
    g = df.groupBy(*subset).agg(F.min_by(F.struct(*[F.col(c) for c in others]), F.col(order_by)).alias("_r"))
    return g.select(*subset, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*df.columns)


def one_hot_candidates(df: DataFrame) -> list[str]:
    """Categorical columns whose name contains neither 'id' nor 'date'."""
    return [c for c in categorical_columns(df) if "id" not in c.lower() and "date" not in c.lower()]


def one_hot(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Dummy columns ``{col}_{value}`` (int) with the first sorted category dropped; a null row
    is all zeros; source columns are removed.

    The result has a column per value, so its schema (and nothing else) is what the driver collects."""
    out = df
    for c in cols:
        vals = [r[0] for r in df.select(F.col(c).cast("string")).filter(F.col(c).isNotNull()).distinct().orderBy(c).collect()]
        new = [F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
               for v in vals[1:]]
        out = out.select(*[x for x in out.columns if x != c], *new)
    return out


def encode_treatment(df: DataFrame, col: str, treat, control=None, new_col: str | None = None) -> DataFrame:
    """PRE15 one-vs-rest (``control`` None: treat->1, everything else incl. null->0) or
    pair (control->0, treat->1, other rows dropped)."""
    new_col = new_col or col
    c = F.col(col)
    if control is None:
        enc = F.when(c.eqNullSafe(F.lit(treat)), 1).otherwise(0)
        base = df
    else:
        base = df.filter(c.isin(treat, control))
        enc = F.when(c == F.lit(treat), 1).otherwise(0)
    return base.select(*[x for x in base.columns if x != new_col], enc.cast("int").alias(new_col))


# PRE16 --------------------------------------------------------------------------------------------

def apply_recipe(df: DataFrame, recipe: Sequence[dict]) -> DataFrame:
    """Replay an ordered list of steps; each step is {"op": name, ...params}.

    ops: impute_numeric, impute_categorical, winsorize, log, standardize, filter,
    bucket (method "cut"|"qcut"), override, one_hot, encode_treatment, cast_numeric.
    """
    def step(d: DataFrame, s: dict) -> DataFrame:
        s = dict(s)
        op = s.pop("op")
        if op == "impute_numeric":
            return impute_numeric(d, s.get("cols"), s.get("method", "Mean"), s.get("value"))
        if op == "impute_categorical":
            return impute_categorical(d, s.get("cols"), s.get("method", "Mode"), s.get("value"))
        if op == "winsorize":
            return winsorize(d, s["cols"], s.get("p", 0.05))
        if op == "log":
            return log_transform(d, s["cols"])
        if op == "standardize":
            return standardize(d, s["cols"])
        if op == "filter":
            return apply_filter(d, s["col"], s["op_"], s["val"])
        if op == "bucket":
            fn = bucket_equal_width if s.get("method", "cut") == "cut" else bucket_quantile
            return fn(d, s["col"], s["n_bins"], s.get("new_col"))
        if op == "override":
            return override(d, s["target"], s["value"], s["cond_col"], s["cond_op"], s["cond_val"])[0]
        if op == "one_hot":
            return one_hot(d, s["cols"])
        if op == "encode_treatment":
            return encode_treatment(d, s["col"], s["treat"], s.get("control"), s.get("new_col"))
        if op == "cast_numeric":
            return coerce(d, s["cols"], s.get("dates", ()), s.get("keep"))
        raise ValueError(op)
    return reduce(step, recipe, df)


# PRE17 / PRE18 ------------------------------------------------------------------------------------

def coerce(df: DataFrame, numeric: Sequence[str], dates: Sequence[str] = (), keep: Sequence[str] | None = None,
           strict: bool = False) -> DataFrame:
    """to_numeric (``try_cast`` = errors='coerce'; strict raises), to_date, then drop rows with a
    null in the used columns and project to them."""
    used = list(keep or (list(numeric) + list(dates)))
    cols = []
    for c in used:
        if c in numeric:
            e = F.col(c).cast("double") if strict else F.col(c).try_cast("double")
            cols.append(e.alias(c))
        elif c in dates:
            cols.append(F.to_date(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols).dropna(subset=used)


def historical_cutoff(df: DataFrame, date_col: str, cutoff: str) -> DataFrame:
    """PRE18: rows strictly before the cutoff date (pushed to the scan)."""
    return df.filter(F.col(date_col) < F.lit(cutoff).cast("date"))
