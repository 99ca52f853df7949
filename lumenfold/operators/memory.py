"""Sessions and memory: state of conversations, a semantic cache, per-user recall, rollups, recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dense import dense_top
from .retrieval import inner, top


def session_state(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, last_turn, last_role, last_user_text."""
    return conversations.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.max("turn").alias("last_turn"),
        F.max_by("role", "turn").alias("last_role"),
        F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("last_user_text"),
    )


def cache_lookup(queries: DataFrame, cache: DataFrame, threshold: float) -> DataFrame:
    """query_id, response_id, score, hit: the nearest cached key (vec_id, embedding), a hit from the threshold on."""
    best = dense_top(queries, cache, 1)
    found = best.where(F.col("score") >= threshold).select("query_id", F.col("vec_id").alias("response_id"), "score")
    return queries.select("query_id").join(found, "query_id", "left").withColumn("hit", F.col("response_id").isNotNull())


def recall(queries: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank among the memories of the query's own user (label): never another's.

    The join is on the user, so no pair of different users is scored; AQE splits a user of very many memories.
    """
    own = memories.select("vec_id", "embedding", F.col("label").alias("owner"))
    met = queries.join(own, F.col("user") == F.col("owner")).where((F.col("query_id") != F.col("vec_id")) & (F.size("embedding") == F.size("qvec")))
    return top(met.select("query_id", "vec_id", inner(F.col("qvec"), F.col("embedding")).alias("score")), "query_id", "vec_id", k)


def long_term(events: DataFrame) -> DataFrame:
    """user_id, n_events, n_types, total, first_ts, last_ts."""
    return events.groupBy("user_id").agg(F.count("*").alias("n_events"), F.countDistinct("event_type").alias("n_types"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def recovered(conversations: DataFrame) -> DataFrame:
    """conv_id, history: the turns in order, as role and text."""
    own = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("h"))
    return own.select("conv_id", F.array_join(F.transform("h", lambda x: F.concat_ws(": ", x.role, x.text)), "\n").alias("history"))
