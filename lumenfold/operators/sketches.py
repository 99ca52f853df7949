"""Mergeable sketches: distinct counts (HyperLogLog) and quantiles (KLL) as binary columns, rolled up without the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct count (2 to that power: a relative error of 0.8 % or less), size of a quantile sketch.
LOG_REGISTERS, KLL = 14, 400


def sketched(rows: DataFrame, keys: list[str], distinct: str, measure: str) -> DataFrame:
    """keys, n, distinct_sketch, value_sketch: one row for each combination of the keys; nulls aren't in the sketches."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, LOG_REGISTERS).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(measure).cast("double"), KLL).alias("value_sketch"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser keys, from those of finer ones alone. Parts that were sketched at other times merge alike."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch", KLL).alias("value_sketch"))


def estimated(sketches: DataFrame, quantile: float = 0.5) -> DataFrame:
    """The sketches' columns as n_distinct and quantile."""
    own = sketches.withColumn("n_distinct", F.hll_sketch_estimate("distinct_sketch")).withColumn("quantile", F.kll_sketch_get_quantile_double("value_sketch", F.lit(quantile)))
    return own.drop("distinct_sketch", "value_sketch")
