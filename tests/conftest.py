import math
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.01"
SF_SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]").appName("causeway-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="causeway-test-ckpt-"))
    yield s


def normal_cols(F, idcol, seed, tag):
    """Deterministic N(0,1) column from md5 uniforms (identical under any partitioning)."""
    from causeway.functions.columns import std_normal, uniform
    return std_normal(uniform(F.col(idcol), F.lit(seed), F.lit(f"{tag}a")),
                      uniform(F.col(idcol), F.lit(seed), F.lit(f"{tag}b")))


def unif(F, idcol, seed, tag):
    from causeway.functions.columns import uniform
    return uniform(F.col(idcol), F.lit(seed), F.lit(tag))


__all__ = ["SF", "SF_SMOKE", "normal_cols", "unif", "math"]
