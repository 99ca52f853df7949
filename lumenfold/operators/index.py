"""A block index of a corpus for BM25: written once, then read by every query set.

A block is a run of documents (at most BLOCK_DOCS of them and about BLOCK_TERMS terms). A row holds the postings of one
term in one block as packed arrays, so a frequent term is as many rows as there are blocks. Rows are partitioned by a hash
of the term and sorted by it: a query set reads the partitions of its own terms only. Beside the arrays a row has what
bounds the term's weight in the block (the largest tf, the least length for a tf); blocks that can't reach a query's
k-th best score are left out by these bounds alone, and within a block lists that can't are only looked into (MaxScore).

The weights' constants (k1, b) and the mean length are the reader's: the index is right for any, and stays so when blocks
are added.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.memory import give_back, tidied
from ..functions.text import terms
from ..sources.shared import kept, shared_folder
from .retrieval import B, K1, top

BLOCK_DOCS, BLOCK_TERMS = 4096, 4_000_000
#: Bytes of text to a partition of terms.
PARTITION_BYTES = 32_000_000
#: Queries to a group, which a task scores over a block at once.
GROUP = 512
#: Blocks of each query that are scored first, to know its bar.
FIRST = 2
#: An index of so few blocks is scored in one pass.
ONE_PASS = 8
#: Scores count as equal within this much: they are rounded to six digits.
SLACK = 2e-6
#: The partition of the rows that describe blocks.
BLOCKS = -1

_ROW = "part int, term string, block long, n long, cf long, max_tf long, min_ratio double, docs binary, tfs binary, lengths binary, ids array<{id}>"


def _bucket(parts: int):
    return F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")


def write_index(docs: DataFrame, folder: str, parts: int | None = None, block_docs: int = BLOCK_DOCS, block_terms: int = BLOCK_TERMS) -> None:
    """Index of docs (doc_id, text) as a table in folder. Every row is a document; null and empty texts have no terms.

    Blocks are made where documents are read; what is shuffled is packed postings.
    """
    kind = docs.schema["doc_id"].dataType
    if parts is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        parts = int(min(4096, max(16, -(-size // PARTITION_BYTES))))

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        ids, lists, n_docs, n_terms = [], [], 0, 0
        for batch in batches:
            at, lengths = 0, batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            while at < batch.num_rows:
                total = n_terms + np.cumsum(lengths[at : at + block_docs - n_docs])
                m = int(np.searchsorted(total, block_terms, "right"))
                m = max(m, 1) if not n_docs else m
                if m:
                    ids.append(batch.column(0).slice(at, m))
                    lists.append(batch.column(1).slice(at, m))
                    n_docs, n_terms, at = n_docs + m, int(total[m - 1]), at + m
                if n_docs >= block_docs or at < batch.num_rows:
                    yield from _block(number, ids, lists, kind_arrow)
                    number, ids, lists, n_docs, n_terms = number + 1, [], [], 0, 0
                    give_back()
        if n_docs:
            yield from _block(number, ids, lists, kind_arrow)

    from pyspark.sql.pandas.types import to_arrow_type

    kind_arrow = to_arrow_type(kind)
    made = docs.select("doc_id", terms(F.col("text")).alias("terms")).mapInArrow(tidied(run), _ROW.format(id=kind.simpleString()))
    placed = made.withColumn("part", F.when(F.col("term").isNull(), F.lit(BLOCKS)).otherwise(_bucket(parts)))
    task = F.when(F.col("term").isNull(), F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")).otherwise(F.col("part"))  # a partition each; hashed anew, several would meet in one task
    placed.repartitionById(parts, task).sortWithinPartitions("part", "term", "block").write.partitionBy("part").option("parquet.block.size", 8 << 20).parquet(f"{folder}/postings")
    docs.sparkSession.createDataFrame([(parts, kind.simpleString())], "parts int, id string").coalesce(1).write.parquet(f"{folder}/layout")


def _block(number: int, ids: list, lists: list, kind) -> Iterator[pa.RecordBatch]:
    """Rows of a block: one that describes it, then one for each term, 20,000 at a time. Empties lists."""
    lengths = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in lists]).astype("<u4")
    words = pa.chunked_array([x.flatten() for x in lists])
    own = words.dictionary_encode().unify_dictionaries()  # chunk by chunk: the words aren't copied
    names = own.chunk(0).dictionary if own.num_chunks else pa.array([], pa.string())
    order = pc.sort_indices(names)  # a block's rows come sorted: the sort by term then merges runs
    names, place, at = names.take(order), np.argsort(order.to_numpy()), 0
    key = np.empty(len(own), np.int64)
    for x in own.chunks:
        key[at : at + len(x)] = place[x.indices.to_numpy(zero_copy_only=False)]
        at += len(x)
    lists.clear()
    del words, own
    n_docs = len(lengths)
    key *= n_docs
    key += np.repeat(np.arange(n_docs, dtype=np.uint16 if n_docs <= 1 << 16 else np.int64), lengths)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool))
    tf = np.diff(np.append(first, len(key))).astype("<u4")
    key = key[first]
    del first
    term, doc = (key // n_docs).astype(np.int32), (key % n_docs).astype("<u4")
    del key
    starts = np.searchsorted(term, np.arange(len(names) + 1))
    schema = _schema(kind)
    about = {"part": BLOCKS, "block": number, "n": n_docs, "cf": int(lengths.sum()), "lengths": lengths.tobytes()}
    cells = [pa.array([about.get(f.name)], f.type) for f in list(schema)[:-1]] + [pa.ListArray.from_arrays(pa.array([0, n_docs], pa.int32()), pa.concat_arrays(ids).cast(kind))]
    yield pa.RecordBatch.from_arrays(cells, schema=schema)
    if not len(names):
        return
    n, cf = np.diff(starts), np.add.reduceat(tf.astype(np.int64), starts[:-1])
    most, least = np.maximum.reduceat(tf, starts[:-1]), np.minimum.reduceat(lengths[doc] / tf, starts[:-1])
    for lo in range(0, len(names), 20_000):
        hi = min(lo + 20_000, len(names))
        m = hi - lo
        edges, raw = (4 * (starts[lo : hi + 1] - starts[lo])).astype(np.int32), slice(int(starts[lo]), int(starts[hi]))
        packed = [pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(x[raw]))]) for x in (doc, tf)]
        cells = [pa.array(np.zeros(m, np.int32)), names.slice(lo, m), pa.array(np.full(m, number)), pa.array(n[lo:hi]), pa.array(cf[lo:hi]), pa.array(most[lo:hi].astype(np.int64)), pa.array(least[lo:hi]), *packed, pa.nulls(m, pa.binary()), pa.nulls(m, pa.list_(kind))]
        yield pa.RecordBatch.from_arrays(cells, schema=schema)


def _schema(kind) -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("term", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("cf", pa.int64()), ("max_tf", pa.int64()), ("min_ratio", pa.float64()), ("docs", pa.binary()), ("tfs", pa.binary()), ("lengths", pa.binary()), ("ids", pa.list_(kind))])


class Index:
    """Reader of what write_index wrote."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.parts, kind = spark.read.parquet(f"{folder}/layout").first()
        self.rows = spark.read.schema(_ROW.format(id=kind)).parquet(f"{folder}/postings")
        self.blocks = self.rows.where(F.col("part") == BLOCKS)
        self.n, tokens, self.n_blocks = self.blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("cf"), F.lit(0)), F.count("*")).first()
        self.mean = tokens / self.n if tokens else 1.0
        self.whole, self.only = self, None

    def terms(self) -> DataFrame:
        """term, df, cf of the corpus."""
        return self.rows.where(F.col("part") != BLOCKS).groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))

    def documents_of(self, asked: DataFrame) -> DataFrame:
        """term, doc_id of the documents that hold each of some distinct terms (term)."""
        found = asked.select(_bucket(self.parts).alias("part")).groupBy("part").agg(F.lit(0)).collect()
        own = self.postings(sorted(r[0] for r in found)).join(asked.select("term"), "term", "left_semi").select("block", "term", "docs")
        ids = self.rows.schema["ids"].dataType.elementType
        out = T.StructType([T.StructField("term", T.StringType()), T.StructField("doc_id", ids)])
        return own.groupBy("block").cogroup(self.blocks.select(F.col("block").alias("b"), "ids").groupBy("b")).applyInArrow(_listed, out)

    def counts_of(self, asked: DataFrame) -> DataFrame:
        """term, df of those of some distinct terms (term) that the corpus has."""
        found = asked.select(_bucket(self.parts).alias("part")).groupBy("part").agg(F.lit(0)).collect()
        own = self.postings(sorted(r[0] for r in found)).join(asked.select("term"), "term", "left_semi")
        return own.groupBy("term").agg(F.sum("n").alias("df"))

    def postings(self, buckets: list[int]) -> DataFrame:
        """The rows of some term partitions; others aren't opened."""
        return self.rows.where(F.col("part").isin(*buckets) if buckets else F.lit(False))

    def narrowed(self, queries: DataFrame) -> Index:
        """The index with the postings of the queries' terms alone, for these queries: one pass over the postings, written once.

        Further steps of a run read, join and shuffle what is left instead of all postings; they may share it. Asked to
        narrow to other queries, it goes back to the whole index.
        """
        if self.only and self.only[0].sameSemantics(queries):
            return self
        asked, buckets, groups = self.asked(queries)
        found = self.whole.postings(buckets).join(asked.select("term").distinct(), "term", "left_semi")
        own = copy.copy(self)
        own.rows = kept(found.select(self.rows.columns), shared_folder(self.spark, "narrowed"), "postings")
        own.only = queries, asked, groups
        return own

    def asked(self, queries: DataFrame) -> tuple[DataFrame, list[int], int]:
        """item_id, term of the queries (item_id, text); the term partitions they need; how many groups of queries.

        Only the numbers of partitions (at most as many as the index has) and one count go to the driver.
        """
        each = queries.select("item_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
        found = each.select(_bucket(self.parts).alias("part")).groupBy("part").agg(F.lit(0)).collect()
        return each.distinct(), sorted(r[0] for r in found), max(1, -(-queries.count() // GROUP))

    def top(self, queries: DataFrame, k: int) -> DataFrame:
        """item_id, doc_id, score, rank: the k best documents of each query by BM25, ties to the smaller doc_id.

        A query without terms of the corpus has no rows. Two passes over many blocks: those of the largest bounds first,
        which give each query a bar, then those whose bound reaches it.
        """
        narrow = self.narrowed(queries)
        own, (_, asked, groups) = narrow.rows, narrow.only
        folder = shared_folder(self.spark, "search")
        facts = own.select("term", "block", "n", "max_tf", "min_ratio")
        df = facts.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log((self.n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        least = F.lit(1.0) + F.lit(K1) * (F.lit(1 - B) / F.col("max_tf") + F.lit(B / self.mean) * F.col("min_ratio"))
        met = asked.join(df.withColumn("idf", idf), "term").join(facts, "term").select("item_id", "term", "block", "idf", (F.col("idf") * (K1 + 1) / least).alias("bound"))
        met = kept(met, folder, "met")
        bounds = met.groupBy("item_id", "block").agg(F.sum("bound").alias("bound"))
        if self.n_blocks <= ONE_PASS:
            return top(self._scored(own, met, bounds.select("item_id", "block", F.lit(0.0).alias("bar")), groups, k), "item_id", "doc_id", k)
        placed = bounds.selectExpr("*", "row_number() over (partition by item_id order by bound desc, block) as place")
        bounds = kept(placed, folder, "bounds")
        begun = self._scored(own, met, bounds.where(F.col("place") <= FIRST).select("item_id", "block", F.lit(0.0).alias("bar")), groups, k)
        begun = kept(begun, folder, "begun")
        bar = top(begun, "item_id", "doc_id", k).where(F.col("rank") == k).select("item_id", F.col("score").alias("bar"))
        later = bounds.where(F.col("place") > FIRST).join(bar, "item_id", "left").withColumn("bar", F.coalesce("bar", F.lit(0.0)))
        rest = self._scored(own, met, later.where(F.col("bound") >= F.col("bar") - SLACK).select("item_id", "block", "bar"), groups, k)
        return top(begun.unionByName(rest), "item_id", "doc_id", k)

    def _scored(self, own: DataFrame, met: DataFrame, wanted: DataFrame, groups: int, k: int) -> DataFrame:
        """item_id, doc_id, score: at least the k best of each wanted (item_id, block) that reach the bar."""
        group = F.pmod(F.xxhash64("item_id"), F.lit(groups)).alias("grp")
        need = met.join(wanted, ["item_id", "block"]).groupBy("term", "block", group, "idf").agg(F.collect_list(F.struct("item_id", "bar")).alias("asks"))
        lists = own.join(need, ["term", "block"]).select("grp", "block", "docs", "tfs", "idf", "asks")
        about = self.blocks.join(wanted.select("block", group).distinct(), "block").select(F.col("grp").alias("g"), F.col("block").alias("b"), "lengths", "ids")
        item, ids = met.schema["item_id"].dataType, self.rows.schema["ids"].dataType.elementType
        out = T.StructType([T.StructField("item_id", item), T.StructField("doc_id", ids), T.StructField("score", T.DoubleType())])
        mean = self.mean
        return lists.groupBy("grp", "block").cogroup(about.groupBy("g", "b")).applyInArrow(lambda a, b: _best(a, b, k, mean), out)


def _listed(lists: pa.Table, about: pa.Table) -> pa.Table:
    """The documents of one block in which each term is."""
    ids, terms_, at = about["ids"].combine_chunks().flatten(), lists["term"], [np.frombuffer(x, "<u4") for x in lists["docs"].to_pylist()]
    which = pa.array(np.repeat(np.arange(len(at)), [len(x) for x in at]))
    return pa.table({"term": terms_.take(which), "doc_id": ids.take(pa.array(np.concatenate(at) if at else np.zeros(0, np.int64)))})


def _best(lists: pa.Table, about: pa.Table, k: int, mean: float) -> pa.Table:
    """The best documents of one block for each query that asks for it."""
    lengths = np.frombuffer(about["lengths"][0].as_py(), "<u4")
    ids = about["ids"].combine_chunks().flatten()
    base = K1 * (1 - B + B * lengths / mean)
    asks: dict = {}
    for docs, tfs, idf, own in zip(lists["docs"].to_pylist(), lists["tfs"].to_pylist(), lists["idf"].to_pylist(), lists["asks"].to_pylist(), strict=True):
        docs, tf = np.frombuffer(docs, "<u4"), np.frombuffer(tfs, "<u4")
        weight = idf * tf * (K1 + 1) / (tf + base[docs])
        found = (float(weight.max()), docs, weight)
        for a in own:
            asks.setdefault(a["item_id"], (a["bar"], []))[1].append(found)
    total, items, at, scores = np.zeros(len(lengths)), [], [], []
    for item, (bar, own) in asks.items():
        docs, score = best_of(own, bar, k, total)
        items += [item] * len(docs)
        at.append(docs)
        scores.append(score)
    kind = lists.schema.field("asks").type.value_type.field("item_id").type
    at = np.concatenate(at) if at else np.zeros(0, np.int64)
    return pa.table({"item_id": pa.array(items, kind), "doc_id": ids.take(pa.array(at)), "score": pa.array(np.concatenate(scores) if scores else [], pa.float64())})


def best_of(lists: list[tuple[float, np.ndarray, np.ndarray]], bar: float, k: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of (largest weight, documents, weights) lists: those that reach the bar and are among the k best.

    MaxScore: lists that can't lift a document over the bar by themselves bring in no documents; they are looked into
    for those that the others bring in. total: zeros, one a document; left as zeros.
    """
    lists = sorted(lists, key=lambda x: x[0])
    sums = np.cumsum([x[0] for x in lists])
    loose = int(np.searchsorted(sums, bar - SLACK))
    if loose == len(lists):
        return np.zeros(0, np.int64), np.zeros(0)
    for _, docs, weight in lists[loose:]:
        total[docs] += weight
    found = np.flatnonzero(total)
    if loose:
        found = found[total[found] + sums[loose - 1] >= bar - SLACK]
        extra = np.zeros(len(found))
        for _, docs, weight in lists[:loose]:
            place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            hit = docs[place] == found
            extra[hit] += weight[place[hit]]
        score = total[found] + extra
    else:
        score = total[found]
    for _, docs, _ in lists[loose:]:
        total[docs] = 0
    least = max(bar, float(np.partition(score, -k)[-k]) if len(score) > k else 0.0) - SLACK
    keep = score >= least
    return found[keep], score[keep]


_BUILT: dict[tuple, str] = {}


def index_of(spark: SparkSession, path: str) -> Index:
    """The index of a documents table, built in the shared folder where this session has none of these very files.

    The table's files, their sizes and times are the key: a changed table gets a new index.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(hadoop)
    files = fs.listStatus(hadoop) if status.isDirectory() else [status]
    key = (spark.sparkContext.applicationId, *sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))
    folder = _BUILT.get(key)
    if folder is None:
        folder = shared_folder(spark, f"index-{uuid.uuid4().hex[:8]}")
        write_index(spark.read.parquet(path).select("doc_id", "text"), folder)
        _BUILT[key] = folder
    return Index(spark, folder)
