"""Queries of the retrieval operators: the benchmark items are the query set.

Vectors have no declared link to documents: r05 and r06 take vec_id for doc_id and item_id, which exercises the operators
and gives the ranking no meaning.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators.dense import dense_top
from ..operators.index import index_of
from ..sources.tables import table
from .registry import query

TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
BM = rf"""d as (select doc_id, text, {TERMS.format('text')} as t from documents), q as (select item_id, text as query, list_distinct({TERMS.format('text')}) as t from benchmark),
 n as (select count(*) as n, avg(len(t)) as mean from d), tok as (select doc_id, len(t) as dl, unnest(t) as term from d), qt as (select item_id, unnest(t) as term from q),
 tf as (select doc_id, dl, term, count(*) as tf from tok group by all), df as (select term, count(*) as df from tf group by term),
 bm as (select item_id, doc_id, round(sum(ln((n.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / n.mean))), 6) as score
   from qt join tf using (term) join df using (term), n group by item_id, doc_id),
 bmr as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from bm)"""
DENSE = """dn as (select a.vec_id as query_id, b.vec_id, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) as score
   from embeddings a join embeddings b on a.vec_id <> b.vec_id where {}),
 dnr as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from dn)"""
FUSED = f"""{BM}, {DENSE.format('a.vec_id in (select item_id from benchmark)')},
 two as (select item_id, doc_id, 1.0 / (60 + rank) as s from bmr where rank <= 50 union all select query_id, vec_id, 1.0 / (60 + rank) from dnr where rank <= 50),
 fused as (select item_id, doc_id, round(sum(s), 6) as score from two group by item_id, doc_id),
 fr as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from fused)"""
COVER = "len(list_intersect(q.t, d.t)) / len(q.t)::double"
RERANKED = f"""{FUSED}, c as (select fr.item_id, fr.doc_id, q.query, d.text, q.t as qt, round(case when len(q.t) > 0 then {COVER} else 0 end, 6) as score
   from fr join q using (item_id) join d using (doc_id) where fr.rank <= 20),
 rr as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from c)"""
KEPT = f"{RERANKED}, kept as (select * from rr where score >= 0.5 and rank <= 5)"


def documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def items(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", "text")


def bm25_top(spark, sf, k, index=None):
    return (index or index_of(spark, f"{sf}/documents.parquet")).top(items(spark, sf), k)


def fused_top(spark, sf, k):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = rows.join(items(spark, sf).select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    near = dense_top(asked, rows, 50)
    return R.top(R.fuse(bm25_top(spark, sf, 50), near.withColumnsRenamed({"query_id": "item_id", "vec_id": "doc_id"})), "item_id", "doc_id", k)


def reranked(spark, sf):
    found = R.with_texts(fused_top(spark, sf, 20).select("item_id", "doc_id"), items(spark, sf), documents(spark, sf))
    return R.top(R.rerank(found), "item_id", "doc_id", 20)


@query("r01_tokens", f"with {BM} select doc_id, term, tf from tf")
def _tokens(spark, sf):
    return R.term_counts(documents(spark, sf))


@query("r02_index", f"with {BM} select term, count(*)::bigint as df, sum(tf)::bigint as cf from tf group by term")
def _index(spark, sf):
    return index_of(spark, f"{sf}/documents.parquet").terms()


@query("r03_bm25", f"with {BM} select item_id, doc_id, score, rank from bmr where rank <= 10")
def _bm25(spark, sf):
    return bm25_top(spark, sf, 10)


@query("r04_dense", f"with {DENSE.format('a.vec_id % 100 = 0')} select query_id, vec_id, score, rank from dnr where rank <= 10")
def _dense(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return dense_top(asked, rows, 10)


@query("r05_rrf", f"with {FUSED} select item_id, doc_id, score, rank from fr")
def _rrf(spark, sf):
    return fused_top(spark, sf, 1000)


@query("r06_hybrid", f"with {FUSED} select item_id, doc_id, score, rank from fr where rank <= 10")
def _hybrid(spark, sf):
    return fused_top(spark, sf, 10)


@query("r07_rerank_surrogate", f"with {RERANKED} select item_id, doc_id, score, rank from rr")
def _rerank(spark, sf):
    return reranked(spark, sf).select("item_id", "doc_id", "score", "rank")


@query("r08_filter", f"with {KEPT} select item_id, doc_id, score, rank from kept")
def _filter(spark, sf):
    return reranked(spark, sf).where("score >= 0.5 and rank <= 5").select("item_id", "doc_id", "score", "rank")


@query(
    "r09_compress",
    rf"""with {KEPT}, e as (select item_id, doc_id, query, qt, list_filter(list_transform(string_split_regex(text, '[.\n]'), lambda s: trim(s, ' ')), lambda s: s <> '') as ss from kept),
    f as (select item_id, doc_id, qt, unnest(ss) as sentence, generate_subscripts(ss, 1) - 1 as pos from e),
    g as (select *, len(list_intersect(qt, {TERMS.format('sentence')})) as hits, length(sentence) as n from f),
    h as (select *, sum(n) over (partition by item_id, doc_id order by hits desc, pos rows between unbounded preceding and current row) as used from g)
    select item_id, doc_id, string_agg(sentence, ' ' order by pos) as context, sum(n)::bigint as chars from h where used <= 400 and hits > 0 group by item_id, doc_id""",
)
def _compress(spark, sf):
    return R.compressed(reranked(spark, sf).where("score >= 0.5 and rank <= 5"), 400)
