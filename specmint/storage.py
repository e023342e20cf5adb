"""Shared intermediate storage.

Lineage is cut by writing Parquet below the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver can read it, so a lost
executor never takes the only copy with it.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PREFIX = f"specmint-{uuid.uuid4().hex[:12]}"


def shared_dir(spark: SparkSession) -> str:
    """Fully qualified URI of this application's folder in the shared directory.

    Where the session names no folder a temporary one is set if the master is local, as in tests.
    On a cluster each machine would have a folder of its own there, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="specmint-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/{_PREFIX}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = fs.makeQualified(path).toString()
    if _PREFIX not in _created:
        _created.add(_PREFIX)
        atexit.register(_remove, spark, uri)
    return uri


_created: set[str] = set()


def _remove(spark: SparkSession, uri: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may already be gone at interpreter exit
        return


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
