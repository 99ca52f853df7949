"""Connected components by alternating large and small stars (Kiveris et al., "Connected components in MapReduce and beyond").

Edges stay distributed: every step is a grouped minimum (summed before its shuffle) and a join on the vertex, whose hot
vertices Spark's skew join splits. Each round is a written table, so that lineage stays short and lost executors cost one
round. Only a count and a checksum come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def _apart(column: str):
    """The same number, under an expression that carries no partitioning: both sides of the join are dealt anew."""
    return F.col(column).bitwiseXOR(F.lit(0))


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(_apart("u").alias("k"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least.select(_apart("u").alias("k"), "m"), F.col("u") == F.col("k")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, folder: str, name: str = "components", rounds: int = 60) -> DataFrame:
    """(v, root) of every vertex that has an edge and isn't its component's least: root is the least vertex reachable.

    edges: columns a, b (long); either order, repeats, loops and rows with nulls are allowed.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = written(e, folder, f"{name}-0"), None
    for k in range(1, rounds + 1):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == seen:
            return e.select(F.col("u").alias("v"), F.col("v").alias("root"))
        seen = now
        e = written(_small(written(_large(e), folder, f"{name}-{k}-large")), folder, f"{name}-{k}")
        remove(edges.sparkSession, folder, f"{name}-{k - 1}", f"{name}-{k}-large")
    raise RuntimeError("components didn't settle")
