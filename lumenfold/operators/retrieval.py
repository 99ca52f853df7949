"""Retrieval: BM25, exact vector search in query blocks, rank fusion, a surrogate reranker, filtering, compression.

Published definitions; the constants are this engine's choices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences, terms
from ..sources.shared import kept, shared_folder

K1, B, RRF = 1.2, 0.75, 60
#: Queries to a block: a block travels as one row.
QUERY_BLOCK = 512


def top(scored: DataFrame, key: str, item: str, k: int, score: str = "score") -> DataFrame:
    """The k best rows of each key with their rank; scores are rounded so that engines agree on ties, then by id."""
    own = scored.withColumn(score, F.round(score, 6))
    return own.selectExpr("*", f"cast(row_number() over (partition by {key} order by {score} desc, {item}) as int) as rank").where(F.col("rank") <= k)


def tokens(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, terms(F.col("text")).alias("terms"))


def term_counts(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf."""
    return tokens(docs).select("doc_id", F.explode("terms").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def term_index(docs: DataFrame) -> DataFrame:
    """term, df, cf of the corpus."""
    return term_counts(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id, score of every document that holds a query's term.

    Only the queries' terms are counted, before anything is shuffled; N and the mean length are taken over all documents.
    """
    asked = tokens(queries, "item_id").select("item_id", F.explode(F.array_distinct("terms")).alias("term"))
    own = tokens(docs).withColumn("dl", F.size("terms"))
    n, mean = own.agg(F.count("*"), F.avg("dl")).first()
    hits = own.select("doc_id", "dl", F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = hits.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("term").agg(F.log((n - F.count("*") + 0.5) / (F.count("*") + 0.5) + 1).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(mean or 1.0))))
    return tf.join(idf, "term").select("term", "doc_id", weight.alias("w")).join(asked, "term").groupBy("item_id", "doc_id").agg(F.sum("w").alias("score"))


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, vec_id, score of a stated query set (query_id, qvec) against all rows (vec_id, embedding).

    Queries are gathered into blocks of about QUERY_BLOCK; a row meets each block once.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "qvec")).alias("q"))
    spread = rows.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    met = spread.join(block, "block").select("vec_id", "embedding", F.explode("q").alias("q"))
    return met.where(F.size("embedding") == F.size("q.qvec")).select(F.col("q.query_id").alias("query_id"), "vec_id", inner(F.col("q.qvec"), F.col("embedding")).alias("score"))


def fuse(*ranked: DataFrame, constant: int = RRF) -> DataFrame:
    """item_id, doc_id, score: reciprocal rank fusion of lists with item_id, doc_id, rank, in any number and order."""
    every = None
    for r in ranked:
        own = r.select("item_id", "doc_id", (F.lit(1.0) / (F.col("rank") + constant)).alias("s"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("item_id", "doc_id").agg(F.sum("s").alias("score"))


def with_texts(candidates: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """candidates with query (the query's text) and text (the document's).

    Candidates are written before they meet the documents: where they are few they are broadcast, and no other text is shuffled.
    """
    own = kept(candidates, shared_folder(candidates.sparkSession, "candidates"), "candidates")
    both = own.join(docs.select("doc_id", "text"), "doc_id").join(queries.select("item_id", F.col("text").alias("query")), "item_id")
    return both.select("doc_id", "item_id", *(c for c in own.columns if c not in ("doc_id", "item_id")), "query", "text")


def coverage(query: Column, text: Column) -> Column:
    """Share of the query's distinct terms that the text holds: a lexical surrogate for a neural reranker."""
    # Both lists are bound to a lambda's variable: named in each place, they would be split anew there.
    both = F.array(F.struct(F.array_distinct(terms(query)).alias("q"), terms(text).alias("t")))
    return F.transform(both, lambda x: F.when(F.size(x.q) > 0, F.size(F.array_intersect(x.q, x.t)) / F.size(x.q)).otherwise(F.lit(0.0)))[0]


def rerank(candidates: DataFrame, scorer=coverage) -> DataFrame:
    """Candidates with their texts, scored anew; scorer: a function of the query's and the text's column."""
    return candidates.withColumn("score", scorer(F.col("query"), F.col("text")))


def compressed(evidence: DataFrame, budget: int) -> DataFrame:
    """context and chars of each (item_id, doc_id): its sentences by the query's terms in them, while they fit the budget.

    Sentences that fit are put back in their order.
    """
    own = evidence.select("item_id", "doc_id", "text", F.array_distinct(terms(F.col("query"))).alias("asked"))
    each = own.select("item_id", "doc_id", "asked", F.posexplode_outer(sentences(F.col("text"))).alias("pos", "sentence"))
    scored = each.withColumn("hits", F.size(F.array_intersect("asked", terms(F.col("sentence"))))).withColumn("n", F.char_length("sentence"))
    kept = scored.selectExpr("*", "sum(n) over (partition by item_id, doc_id order by hits desc, pos rows between unbounded preceding and current row) as used").where((F.col("used") <= budget) & (F.col("hits") > 0))
    out = kept.groupBy("item_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("s"), F.sum("n").alias("chars"))
    return out.select("item_id", "doc_id", F.array_join(F.transform("s", lambda x: x.sentence), " ").alias("context"), "chars")
