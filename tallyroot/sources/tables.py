"""Reading the project's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` below `folder`: one parquet file or a folder of them."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def names(spark: SparkSession, folder: str) -> list[str]:
    """The tables below `folder`."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f.getPath().getName().removesuffix(".parquet") for f in found if f.getPath().getName().endswith(".parquet"))
