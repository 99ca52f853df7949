"""Readers of the tables a query runs over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ts as TIMESTAMP: watermarks don't take TIMESTAMP_NTZ."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
