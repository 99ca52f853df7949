"""Query routing: what a question needs, and which document a follow-up means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lexicons and patterns, the same in RE2.
DEICTIC = r"(?i)\b(?:this|that|these|those|it|they|one)\b"
STRUCTURE = r"(?i)\b(page|section|figure|table|chapter|equation)\s+([0-9]+)"
SHORT = 100


def routed(best: DataFrame, threshold: float) -> DataFrame:
    """item_id, route: grounded if the best evidence (item_id, score) reaches the threshold, else general."""
    return best.select("item_id", F.when(F.coalesce("score", F.lit(0.0)) >= threshold, "grounded").otherwise("general").alias("route"))


def user_turns(conversations: DataFrame) -> DataFrame:
    """The users' turns with their number (from 1) among the users' turns of the conversation."""
    return conversations.where("role = 'user'").selectExpr("conv_id", "turn", "text", "cast(row_number() over (partition by conv_id order by turn) as int) as nth")


def follow_ups(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, follow_up: a short user turn that isn't the first."""
    return user_turns(conversations).select("conv_id", "turn", ((F.col("nth") > 1) & (F.char_length(F.coalesce("text", F.lit(""))) < SHORT)).alias("follow_up"))


def ambiguous(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, refers, ambiguous: a deictic word, without an earlier user turn that it could refer to."""
    refers = F.coalesce(F.col("text").rlike(DEICTIC), F.lit(False))
    return user_turns(conversations).select("conv_id", "turn", refers.alias("refers"), (refers & (F.col("nth") == 1)).alias("ambiguous"))


def structural(text: Column) -> Column:
    """Struct of the part and number that a text asks for; null if none."""
    return F.when(F.coalesce(text.rlike(STRUCTURE), F.lit(False)), F.struct(F.lower(F.regexp_extract(text, STRUCTURE, 1)).alias("part"), F.regexp_extract(text, STRUCTURE, 2).cast("int").alias("number")))


def abstained(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """The items without any evidence: they aren't forced into documents."""
    return items.join(evidence.select("item_id").distinct(), "item_id", "left_anti")


def resolved(turns: DataFrame) -> DataFrame:
    """turns (session, turn, doc_id or null) with the last document named so far."""
    return turns.selectExpr("session", "turn", "last(doc_id, true) over (partition by session order by turn rows between unbounded preceding and current row) as doc_id")
