"""What driver and executors share: this package, and tables stored between steps."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package where it runs from a checkout and isn't installed."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if root not in sys.path:
        sys.path.append(root)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a folder of our own: on a cluster that would be one machine's, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(Path(tempfile.mkdtemp(prefix="spark-")).as_uri())
        found = spark.sparkContext.getCheckpointDir()
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
