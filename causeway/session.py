"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "causeway", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``shuffle_partitions`` is set only when given or when ``master`` is local (8); a cluster's
    own value stands.  ``spark.checkpoint.dir`` is only set for local masters that lack it.
    The package is shipped to the executors."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is None and (master or "").startswith("local"):
        shuffle_partitions = 8
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> str:
    """Send this package's sources to the executors, so that Python workers can import them
    wherever they were started.  Returns the archive's path (on the driver)."""
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="causeway-pkg-"), "causeway.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("causeway", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    return path


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests, one machine) gets a temporary folder; a cluster
    raises, because no folder of the driver's machine is seen by its executors.  With Spark
    Connect (no SparkContext on the client) the server's configuration applies."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: checkpointing is configured server side
        return path
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not _is_local(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="causeway-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (for written tables)."""
    base = ensure_checkpoint_dir(spark)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a shared folder for written tables")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def written(df, name: str):
    """Write ``df`` as Parquet in the shared folder and read it back (cuts the lineage)."""
    return written_at(df, name)[0]


def written_at(df, name: str):
    """(``df`` written as Parquet in the shared folder and read back, its path)."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove_written(spark: SparkSession, *paths: str) -> None:
    """Remove written tables that no result reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
