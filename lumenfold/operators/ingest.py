"""Ingestion: page blocks, equations, captions, chunks, exact and near duplicates, scope, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TERM, chunk_starts, terms
from .near import WORDS

# Patterns, the same in RE2.
BOILERPLATE = r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>|<div class=\"ad\">.*?</div>"
INLINE = r"(?i)</?(?:b|a|i|u|em|strong|span|br)(?: [^>]*)?/?>"
BLOCK = r"(?is)<(?:title|h1|h2|h3|p|li|figcaption)[^>]*>[^<]*"
EQUATION = r"[A-Za-z][A-Za-z0-9_]* = [\"A-Za-z0-9_+*/^().-]+"
CAPTION = r"(?is)<figcaption[^>]*>[^<]*|<img [^>]*alt=\"[^\"]*\""
SCOPE = r"(?i)licen[cs]e|copyright|rights reserved"


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, ordinal (from 1), kind, text of a page's headings, paragraphs and list items without boilerplate."""
    clean = F.regexp_replace(F.regexp_replace(F.col("html"), BOILERPLATE, " "), INLINE, "")
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all(clean, F.lit(f"({BLOCK})"), 1)).alias("i", "m"))
    kind = F.lower(F.regexp_extract("m", r"^<([A-Za-z0-9]+)", 1))
    named = F.when(kind.isin("title", "h1", "h2", "h3"), "heading").when(kind == "li", "list_item").when(kind == "figcaption", "caption").otherwise("paragraph")
    return each.select("page_id", (F.col("i") + 1).alias("ordinal"), named.alias("kind"), F.trim(F.regexp_extract("m", r"(?s)>(.*)$", 1)).alias("text")).where("text <> ''")


def equations(docs: DataFrame) -> DataFrame:
    """doc_id, ordinal, equation: what reads "name = term"."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"({EQUATION})"), 1)).alias("i", "equation")).select("doc_id", (F.col("i") + 1).alias("ordinal"), "equation")


def captions(pages: DataFrame) -> DataFrame:
    """page_id, ordinal, text of figure captions and image descriptions."""
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(f"({CAPTION})"), 1)).alias("i", "m"))
    text = F.when(F.lower("m").startswith("<img"), F.regexp_extract("m", r"(?is)alt=\"([^\"]*)\"", 1)).otherwise(F.regexp_extract("m", r"(?s)>(.*)$", 1))
    return each.select("page_id", (F.col("i") + 1).alias("ordinal"), F.trim(text).alias("text"))


def chunks(docs: DataFrame, length: int = 1000, stride: int = 800) -> DataFrame:
    """doc_id, chunk_id, start, end, text: windows of so many characters; each but a text's last is full."""
    each = docs.select("doc_id", "text", F.explode(chunk_starts(F.col("text"), length, stride)).alias("chunk_id"))
    start = F.col("chunk_id") * stride
    return each.select("doc_id", "chunk_id", start.alias("start"), F.least(start + length, F.char_length("text")).alias("end"), F.substring(F.col("text"), start + 1, F.lit(length)).alias("text"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keeper (least doc_id with the same text), kept. The digest is joined, not the text."""
    keyed = docs.select("doc_id", F.md5("text").alias("digest"))
    keepers = keyed.groupBy("digest").agg(F.min("doc_id").alias("keeper"))
    return keyed.join(keepers, "digest").select("doc_id", "keeper", (F.col("doc_id") == F.col("keeper")).alias("kept"))


def shingles(words: Column, n: int = WORDS) -> Column:
    """Distinct runs of n words; with fewer words all of them as one, none without words."""
    # The words are bound to a lambda's variable: named as an expression, they would be split anew at each mention.
    runs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n, F.lit(0)) + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))
    return F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(F.array().cast("array<string>")))[0]


def minhash(docs: DataFrame, seeds: int = 4) -> DataFrame:
    """doc_id, seed, minhash: the least digest of a document's shingles under each seed."""
    # A filter on the shingles would be pushed below them, and make them twice.
    own = docs.where(F.lower("text").rlike(TERM)).select("doc_id", shingles(terms(F.col("text"))).alias("s"))
    each = own.select("doc_id", "s", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    return each.select("doc_id", "seed", F.array_min(F.transform("s", lambda x: F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), x)))).alias("minhash"))


def scope(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.when(F.col("text").rlike(SCOPE), "out_of_scope").otherwise("in_scope").alias("scope"))


def validated(docs: DataFrame, languages: tuple[str, ...] = ("en", "fr", "de", "es")) -> DataFrame:
    """doc_id, verdict: the first check that a document fails, or "ok"."""
    text = F.coalesce(F.col("text"), F.lit(""))
    verdict = F.when(F.trim(text) == "", "empty").when(F.coalesce(F.col("n_chars"), F.lit(-1)) != F.char_length(text), "wrong_length").when(~F.coalesce(F.col("lang"), F.lit("")).isin(*languages), "language").otherwise("ok")
    return docs.select("doc_id", verdict.alias("verdict"))
