"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory``; columns are pruned by the plan that uses it."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df`` as a broadcast side if it has at most ``most`` rows, which are counted; beyond, as it is, and the join moves both sides."""
    return F.broadcast(df) if df.count() <= most else df
