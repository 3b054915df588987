"""Cutting lineage through tables in a folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Where that is unset, a local
session, as in tests, gets one under the system's temporary folder, and a cluster an error.
Staged tables are plain Parquet, so a lost executor never loses them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and staged tables."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="citeloom-"))
        current = sc.getCheckpointDir()
    return current


def stage(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    _STAGED.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_staged(df: DataFrame | None) -> None:
    """Delete the files behind a staged frame that no later plan reads."""
    path = getattr(df, "_staged_path", None)
    if path is None:
        return
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _STAGED:
        _STAGED.remove(path)


def clear_staged(spark: SparkSession) -> int:
    """Delete every table staged in this process; returns how many."""
    jvm = spark.sparkContext._jvm
    n = 0
    while _STAGED:
        target = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        n += 1
    return n
