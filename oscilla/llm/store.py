"""Shared storage: intermediate tables that every executor and the driver can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import new_path
from ..sources.tables import settled as written

__all__ = ["new_path", "removed", "table", "written"]


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it is."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
