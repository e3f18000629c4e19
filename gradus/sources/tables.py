"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Table ``name`` of ``directory`` (one file or a folder of files); the scan is pruned and filtered by Catalyst."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def wide_table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose rows are much work each, as texts are.

    A scan with fewer partitions than there are cores (one small file) is spread by the first column; any other is left as it is.
    """
    rows = table(spark, directory, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, columns[0])
