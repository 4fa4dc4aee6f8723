"""causeway: a Spark-native causal-inference and experiment-analytics library.

Every public operator takes a Spark ``DataFrame`` (plus column names and
parameters) and returns a ``DataFrame``.  Row-proportional work is expressed
with Spark aggregates, windows and joins; only small matrices (k x k Gram
matrices, donors x donors panel Gram matrices, single series of dates) are
solved in numpy inside Spark tasks.

Sub-packages
------------
sources     readers/writers (parquet, CSV with boolean detection, previews)
functions   column helpers (deterministic randomness, rounding), numerics
            (t / normal distributions, small solvers)
operators   profiling, cleaning, chart data, panel shaping, estimators,
            heterogeneity, refutation, quasi-experimental methods
plans       causal views over the driver tables and the query registry
"""

__version__ = "0.1.0"
