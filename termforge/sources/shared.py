"""The folder that all executors share, and tables that are written there to end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names, or the session's own; a temporary one only where neither is set, and never on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="termforge-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_made: set[str] = set()


def new_folder(spark: SparkSession) -> str:
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    _made.add(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete all folders that this process made, once no result that reads them is needed; how many."""
    found = len(_made)
    for path in sorted(_made):
        remove(spark, path)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Written as Parquet and read back: a lost executor costs only the reading task."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that is no longer read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _made.discard(path)
