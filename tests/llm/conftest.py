import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


#: Nulls, empty, blank, very long, repeated rows, ties.
EDGE_DOCS = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", None, 4),
    (4, "the cat sat on the mat and looked at the moon over the quiet hill", "en", "s", 64),
    (5, "the cat sat on the mat and looked at the moon over the quiet hill", "en", "s", 64),
    (5, "the cat sat on the mat and looked at the moon over the quiet hill", "en", "s", 64),
    (None, "the cat sat on the mat and looked at the moon over the quiet hill", "en", "s", 64),
    (6, "word " * 60_000, "en", "t", 300_000),
    (7, "x", "fr", "t", 1),
    (8, "12345 !!! ...", "de", "t", 13),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(EDGE_DOCS, DOC_SCHEMA)


@pytest.fixture(scope="session")
def clashing(edge_docs):
    """The same rows with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F
    names = ["key", "ord", "h", "hs", "class", "grp", "shard", "slot", "score", "rejected", "lang_pred", "start", "length", "ids", "__text", "__row", "old", "size", "crc", "unit", "row", "n"]
    return edge_docs.select("*", *[F.lit(n).alias(n) for n in names])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
