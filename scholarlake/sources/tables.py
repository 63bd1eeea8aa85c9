"""Table access: one Parquet file or folder per table under a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the data folder `sf_dir`; columns are pruned and filters pushed by the caller's plan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
