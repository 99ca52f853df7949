"""Retrieval and answer metrics. Those that others judge by a language model are lexical surrogates here, named _lex."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import overlap, terms
from ..sources.shared import kept, shared_folder
from .index import Index
from .retrieval import with_texts

ENTITY = r"\p{Lu}\p{L}+"


def gold(items: DataFrame, docs: DataFrame, index: Index) -> DataFrame:
    """item_id, doc_id of the documents that contain an item's text; index: that of docs.

    Candidates are the documents of the item's rarest term, from the index: no item meets every document, and only the
    candidates' texts are read for more than their doc_id. The rarest terms are written, as several steps take them.
    """
    words = items.select("item_id", "text", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    counts = index.counts_of(words.select("term").distinct())
    least = words.join(counts, "term").groupBy("item_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    rarest = kept(least, shared_folder(items.sparkSession, "gold"), "rarest")
    pairs = rarest.join(index.documents_of(rarest.select("term").distinct()), "term").select("item_id", "doc_id").distinct()
    both = with_texts(pairs, items, docs)
    return both.where(F.expr("contains(text, query)")).select("item_id", "doc_id")


def judged(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """ranked (item_id, doc_id, rank) of the items that have a relevant document, with rel 0 or 1."""
    marks = relevant.select("item_id", "doc_id").withColumn("rel", F.lit(1))
    own = ranked.join(relevant.select("item_id").distinct(), "item_id", "left_semi")
    return own.join(marks, ["item_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def coverage(ranked: DataFrame) -> DataFrame:
    """n, coverage: items, and the share with a relevant document among those ranked."""
    return ranked.groupBy("item_id").agg(F.max("rel").alias("any")).agg(F.count("*").alias("n"), F.round(F.avg("any"), 6).alias("coverage"))


def precision(ranked: DataFrame) -> DataFrame:
    """item_id, precision: mean over the relevant ranks of the precision so far; 0 without any."""
    so_far = ranked.selectExpr("item_id", "rel", "sum(rel) over (partition by item_id order by rank rows between unbounded preceding and current row) / rank as p")
    return so_far.groupBy("item_id").agg(F.round(F.coalesce(F.sum(F.col("p") * F.col("rel")) / F.nullif(F.sum("rel"), F.lit(0)), F.lit(0.0)), 6).alias("precision"))


def recall(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """item_id, recall: relevant documents ranked, of all relevant ones."""
    total = relevant.groupBy("item_id").agg(F.count("*").alias("total"))
    return ranked.groupBy("item_id").agg(F.sum("rel").alias("hits")).join(total, "item_id").select("item_id", F.round(F.col("hits") / F.col("total"), 6).alias("recall"))


def answers(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, answer, question: assistant turns right after a user's turn."""
    own = conversations.selectExpr("conv_id", "turn", "role", "text as answer", "lag(text) over (partition by conv_id order by turn) as question", "lag(role) over (partition by conv_id order by turn) as before")
    return own.where("role = 'assistant' and before = 'user'").select("conv_id", "turn", "answer", "question")


def faithfulness(answer: Column, context: Column) -> Column:
    return F.round(overlap(terms(answer), terms(context)), 6)


def relevancy(answer: Column, question: Column) -> Column:
    """Shared distinct terms of all distinct terms of both."""
    a, q = F.array_distinct(terms(answer)), F.array_distinct(terms(question))
    both = F.size(F.array_union(a, q))
    return F.round(F.when(both > 0, F.size(F.array_intersect(a, q)) / both).otherwise(F.lit(0.0)), 6)


def correctness(answer: Column, expected: Column) -> Column:
    """F1 of distinct terms."""
    a, e = F.array_distinct(terms(answer)), F.array_distinct(terms(expected))
    total = F.size(a) + F.size(e)
    return F.round(F.when(total > 0, 2 * F.size(F.array_intersect(a, e)) / total).otherwise(F.lit(0.0)), 6)


def entities(text: Column) -> Column:
    return F.array_distinct(F.coalesce(F.regexp_extract_all(text, F.lit(f"({ENTITY})"), 1), F.array().cast("array<string>")))


def entity_recall(answer: Column, expected: Column) -> Column:
    return F.round(overlap(entities(expected), entities(answer)), 6)


def cosine(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """conv_id, turn, cosine of each answer and question as vectors of their terms: tf times ln((N + 1) / (df + 1)) + 1.

    df and N are those of corpus (text). Terms of a pair are counted on both sides at once and weighted by a join on the
    term; no vector is as long as the vocabulary. 0 where either side has no terms.
    """
    n = corpus.count()
    idf = corpus.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg((F.log(F.lit(n + 1.0) / (F.count("*") + 1)) + 1).alias("idf"))
    side = lambda c, a: pairs.select("conv_id", "turn", F.explode(terms(F.col(c))).alias("term"), F.lit(a).alias("a"), F.lit(1 - a).alias("q"))
    counts = side("answer", 1).unionByName(side("question", 0)).groupBy("conv_id", "turn", "term").agg(F.sum("a").alias("a"), F.sum("q").alias("q"))
    w = F.pow(F.coalesce("idf", F.log(F.lit(n + 1.0)) + 1), F.lit(2.0))
    dot = counts.join(idf, "term", "left").groupBy("conv_id", "turn").agg(F.sum(F.col("a") * F.col("q") * w).alias("aq"), F.sum(F.col("a") * F.col("a") * w).alias("aa"), F.sum(F.col("q") * F.col("q") * w).alias("qq"))
    found = dot.select("conv_id", "turn", (F.col("aq") / F.sqrt(F.nullif(F.col("aa") * F.col("qq"), F.lit(0.0)))).alias("c"))
    return pairs.select("conv_id", "turn").join(found, ["conv_id", "turn"], "left").select("conv_id", "turn", F.round(F.coalesce("c", F.lit(0.0)), 6).alias("cosine"))
