"""Reading the Parquet tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name``; a file or a folder of files, both called ``<name>.parquet``."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores, for work that costs much more than moving the rows.

    Only a scan of fewer pieces than cores, such as one small file, is repartitioned; a large table stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
