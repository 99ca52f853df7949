"""Guardrails: isolation, evidence, numbers, groundedness, fallback, rate limits, structured errors, retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import overlap, terms

NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def isolated(rows: DataFrame, owner: str, key: Column) -> DataFrame:
    """The rows of one owner only; a null key owns nothing."""
    return rows.where(F.coalesce(F.col(owner) == key, F.lit(False)))


def evidence_state(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """item_id, supported: whether an item has evidence."""
    own = evidence.select("item_id").distinct().withColumn("supported", F.lit(True))
    return items.select("item_id").join(own, "item_id", "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.coalesce(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1), F.array().cast("array<string>")))


def unsupported_numbers(claim: Column, evidence: Column) -> Column:
    """The numbers of a claim that its evidence lacks."""
    return F.array_except(numbers(claim), numbers(evidence))


def line_numbers(docs: DataFrame) -> DataFrame:
    """r (a number of the row), doc_id, line (from 1), v: the distinct numbers of each line of a text, as written."""
    rows = docs.select(F.monotonically_increasing_id().alias("r"), "doc_id", "text")  # the rows are numbered before they are split
    each = rows.select("r", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    return each.select("r", "doc_id", (F.col("i") + 1).alias("line"), F.explode(numbers(F.col("l"))).alias("v"))


def _by_line(rows: DataFrame, missing: Column, name: str) -> DataFrame:
    found = rows.groupBy("r", "doc_id", "line").agg(F.count("*").cast("int").alias("n_numbers"), F.sum(missing.cast("int")).cast("int").alias(name))
    return found.select("doc_id", "line", "n_numbers", name)


def missing_numbers(docs: DataFrame) -> DataFrame:
    """doc_id, line, n_numbers, n_missing: of each line with numbers, those that no other line of its text has.

    The lines of a number are counted once, so a text costs its numbers, not the square of its lines.
    """
    rows = line_numbers(docs)
    lines = rows.groupBy("r", "v").agg(F.count("*").alias("lines"))
    return _by_line(rows.join(lines, ["r", "v"]), F.col("lines") == 1, "n_missing")


def unmatched_numbers(docs: DataFrame, tolerance: float) -> DataFrame:
    """doc_id, line, n_numbers, n_unmatched: likewise, those that no number of another line comes within the tolerance of.

    Values are dealt into buckets of the tolerance's width. Numbers of one bucket match if two lines have any; of the
    buckets beside it only the nearest values of two different lines are looked at, so a bucket costs its numbers.
    """
    rows = line_numbers(docs).withColumn("v", F.col("v").cast("double")).distinct()
    x = F.col("v") / tolerance
    rows = rows.withColumn("b", F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    ends = rows.groupBy("r", "b").agg(F.max(F.struct("v", "line")).alias("hi"), F.min(F.struct("v", "line")).alias("lo"), (F.min("line") != F.max("line")).alias("shared"))
    other = lambda e: F.when(F.col("line") != F.col(f"{e}.line"), F.col("v"))
    ends = rows.join(ends, ["r", "b"]).groupBy("r", "b", "hi", "lo", "shared").agg(F.max(other("hi")).alias("hi2"), F.min(other("lo")).alias("lo2"))
    below = ends.select("r", (F.col("b") + 1).alias("b"), "hi", "hi2")
    above = ends.select("r", (F.col("b") - 1).alias("b"), "lo", "lo2")
    met = rows.join(ends.select("r", "b", "shared"), ["r", "b"]).join(below, ["r", "b"], "left").join(above, ["r", "b"], "left")
    near = lambda e: F.coalesce(F.abs(F.col("v") - F.when(F.col(f"{e}.line") != F.col("line"), F.col(f"{e}.v")).otherwise(F.col(f"{e}2"))) <= tolerance, F.lit(False))
    return _by_line(met, ~(F.col("shared") | near("hi") | near("lo")), "n_unmatched")


def groundedness(response: Column, context: Column) -> Column:
    """Share of the response's distinct terms that the context has."""
    return overlap(terms(response), terms(context))


def fallback(primary: Column, *others: Column) -> Column:
    return F.coalesce(primary, *others)


def over_limit(events: DataFrame, window: str, limit: int) -> DataFrame:
    """user_id, start, n of tumbling windows with at least so many events."""
    own = events.groupBy("user_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"))
    return own.where(F.col("n") >= limit).select("user_id", F.col("w.start").alias("start"), "n")


def error_body(status: Column, detail: Column) -> Column:
    return F.to_json(F.struct(status.alias("status"), detail.alias("detail")))
