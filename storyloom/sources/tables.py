"""Readers for the Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; timestamps without a zone stay without one, columns are pruned by what the plan uses."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
