"""Approximate nearest neighbours by a forest of random-projection trees.

The trees' planes are fitted on a bounded sample (each plane halves its part of the sample, between two of its vectors);
every row is then indexed in every tree. A query walks all trees through one priority queue, ordered by how far it is on
the other side of the planes passed, and visits leaves until enough candidates are gathered. How many are enough is
measured: for a few queries the true neighbours are found among all rows, and the least number that finds the wanted
share of them is taken. Candidates of a leaf are scored exactly, leaf by leaf, and the best are merged by query.

On vectors without structure (independent coordinates, many dimensions) no index of this kind can pass over much of the
table; the measured number then is a large part of it, and the work grows as queries times rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, shared_dir, written
from .vectors import SWEEP, dimension, matrix, packed, sweep, sweep_batch, unpacked, usable

K, EVERY = 20, 20
TREES = 4
#: Rows the planes are fitted on at most, rows of a leaf that are wanted, rows that a leaf's block holds.
SAMPLE, LEAF, BLOCK = 65_536, 2048, 4096
#: Leaves that a tree has at least, if they hold so many rows each.
LEAVES, LEAST_LEAF = 16, 32
#: Queries by which the number of candidates is measured, and the share of their neighbours that must be found.
MEASURED, RECALL = 200, 0.96
#: Rows of the sample that give each query a bar: the k-th best of those in the leaves it visits. Leaves return only what
#: reaches it, and only leaves return rows: what a query finds doesn't depend on these.
ANCHORS = 8192
SEED = 11


def depth_for(total: int) -> int:
    """Planes above a leaf: leaves of about LEAF rows, smaller ones where that gives fewer than LEAVES, 32 sample rows at least."""
    leaf = min(LEAF, max(LEAST_LEAF, total / LEAVES))
    return max(0, min((SAMPLE // 32).bit_length() - 1, int(np.log2(max(1, total / leaf)))))


class Forest:
    """Complete binary trees of the same depth: node i has children 2i + 1 (below the plane) and 2i + 2."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.depth, self.leaves = depth, 1 << depth
        self.normals = np.zeros((trees, self.leaves - 1, sample.shape[1]))
        self.offsets = np.zeros((trees, self.leaves - 1))
        for t in range(trees):
            own = [np.arange(len(sample))]
            for i in range(self.leaves - 1):
                rows = own[i]
                normal = rng.normal(size=sample.shape[1])
                for _ in range(4 if len(rows) > 1 else 0):
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    if (a != b).any():
                        normal = a - b
                        break
                normal = normal / np.sqrt(normal @ normal)
                side = sample[rows] @ normal
                offset = float(np.median(side)) if len(rows) else 0.0
                self.normals[t, i], self.offsets[t, i] = normal, offset
                own += [rows[side <= offset], rows[side > offset]]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(x), len(self.normals)), np.int64)
        for t in range(len(self.normals)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + ((x * self.normals[t][node]).sum(axis=1) > self.offsets[t][node])
            out[:, t] = node - (self.leaves - 1)
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("nd,tid->nti", x, self.normals, optimize=True) - self.offsets

    def visit(self, margins: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
        """Leaves (tree, leaf) in the order of a query's shared queue, until they hold enough rows."""
        first, found, out = self.leaves - 1, 0, []
        queue = [(-np.inf, t, 0) for t in range(len(margins))]
        while queue and found < enough:
            far, t, node = heapq.heappop(queue)
            if node >= first:
                if counts[t][node - first]:
                    out.append((t, node - first))
                    found += counts[t][node - first]
                continue
            m = margins[t][node]
            heapq.heappush(queue, (max(far, m), t, 2 * node + 1))
            heapq.heappush(queue, (max(far, -m), t, 2 * node + 2))
        return out


def _top(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, qx: np.ndarray, k: int, bars: np.ndarray | None = None):
    """(query, id, score) of each query's k best rows but its own, by score, then by id; the scores are sums in one order.

    bars: scores that a query's rows must reach.
    """
    rough = qx @ x.T
    rough[queries[:, None] == ids[None, :]] = -np.inf
    n = min(k, rough.shape[1])
    bar = np.partition(rough, rough.shape[1] - n, axis=1)[:, rough.shape[1] - n]
    bar = bar if bars is None else np.maximum(bar, bars)
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(bar), bar, 0)))
    q, c = np.nonzero((rough >= (bar - slack)[:, None]) & np.isfinite(rough))
    score = (qx[q] * x[c]).sum(axis=1)
    order = np.lexsort((ids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    best = rank < k
    return queries[q[best]], ids[c[best]], score[best]


def _leaf_search(k: int):
    def make(ids, n, x):
        def feed(qid, qn, qx):
            bars = qn.view(np.float64)  # in the place of a weight
            out = [_top(ids, x, qid[i : i + 512], qx[i : i + 512], k, bars[i : i + 512]) for i in range(0, len(qid), 512)]
            return [np.concatenate(c) for c in zip(*out, strict=True)]

        return feed, lambda: []

    return make


def _vectors(rows: DataFrame, dim: int) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), packed(matrix(b.column(1), dim))], ["id", "vec"])

    return rows.select("vec_id", "embedding").mapInArrow(run, "id long, vec binary")


def _collected(rows: DataFrame, limit: int, dim: int, *order) -> tuple[np.ndarray, np.ndarray]:
    got = rows.orderBy(*order).limit(limit).collect()
    return np.array([r["id"] for r in got], np.int64), np.stack([np.frombuffer(r["vec"], np.float32 if len(r["vec"]) == 4 * dim else np.float64).astype(np.float64) for r in got]) if got else np.empty((0, dim))


def _truth(vectors: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    """The true neighbours of a bounded number of queries among all rows."""
    dim, schema = x.shape[1], "query_id long, id long, score double"

    def run(batches):
        best: list | None = None
        for b in batches:
            if b.num_rows:
                own = _top(b.column(0).to_numpy(), unpacked(b.column(1), dim), ids, x, k)
                best = list(own) if best is None else [np.concatenate(c) for c in zip(best, own, strict=True)]
                order = np.lexsort((best[1], -best[2], best[0]))
                best = [c[order] for c in best]
                kept = np.arange(len(order)) - np.searchsorted(best[0], best[0]) < k
                best = [c[kept] for c in best]
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(best[0], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2], pa.float64())], ["query_id", "id", "score"])

    return _best(vectors.select("id", "vec").mapInArrow(run, schema), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    each = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return each.selectExpr("query_id", "cast(row_number() over (partition by query_id order by score desc, id) as int) as rank", "id as vec_id", "score").where(F.col("rank") <= k)


def measure(forest: Forest, counts: np.ndarray, x: np.ndarray, neighbours: list[np.ndarray], recall: float) -> int:
    """The least number of candidates at which queries find that share of their neighbours on average (+1 leaf)."""
    need = []
    for q, near in zip(x, neighbours, strict=True):
        if not len(near):
            continue
        leaves, left, seen = forest.assign(near), np.ones(len(near), bool), 0
        for t, leaf in forest.visit(forest.margins(q[None])[0], counts, int(counts.sum()) + 1):
            seen += int(counts[t][leaf])
            hit = left & (leaves[:, t] == leaf)
            need += [seen] * int(hit.sum())
            left &= ~hit
            if not left.any():
                break
    return int(np.quantile(need, recall, method="higher")) if need else 1


def search(rows: DataFrame, is_query, k: int = K, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of every query row, by inner product.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do
    rows without a vec_id. A row is no neighbour of rows with its own vec_id; a vec_id on several rows is found once, with
    the best score, and its queries are answered together. Ties go to the smaller vec_id.
    """
    spark = rows.sparkSession
    folder = shared_dir(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dimension(rows, "embedding")
    if not dim:
        return empty
    vectors = written(_vectors(rows.where(usable("embedding") & (F.size("embedding") == dim) & F.col("vec_id").isNotNull()), dim), folder, "vectors")
    asks = is_query(F.col("id"))
    total = vectors.count()
    depth = depth_for(total)
    sample_ids, sample = _collected(vectors, SAMPLE, dim, F.xxhash64("id"), "id")
    forest = Forest(sample, trees, depth)
    shared = spark.sparkContext.broadcast(forest)  # trees * leaves planes: bounded by SAMPLE
    at = np.unique(sample_ids[:ANCHORS], return_index=True)[1]  # a vec_id once: k + 1 of them hold k other rows
    anchors = spark.sparkContext.broadcast((sample[at], forest.assign(sample[at])))

    def index(batches):
        for b in batches:
            if b.num_rows:
                leaf = shared.value.assign(unpacked(b.column(1), dim))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(leaf), pa.list_(pa.int64()))], ["id", "vec", "leaf"])

    indexed = written(vectors.mapInArrow(index, "id long, vec binary, leaf array<long>"), folder, "indexed")
    counts = np.zeros((trees, forest.leaves), np.int64)
    for r in indexed.select(F.posexplode("leaf").alias("t", "leaf")).groupBy("t", "leaf").count().collect():  # one row a leaf
        counts[r["t"], r["leaf"]] = r["count"]
    blocks = np.maximum(1, -(-counts // BLOCK))

    ids, x = _collected(vectors.where(asks), MEASURED, dim, F.xxhash64("id", F.lit(1)), "id")
    if not len(ids):
        return empty
    ids, first = np.unique(ids, return_index=True)
    x, near = x[first], {int(i): [] for i in ids}
    for r in _truth(vectors, ids, x, k).join(vectors.withColumnRenamed("id", "vec_id"), "vec_id").collect():  # MEASURED * k rows
        near[r["query_id"]].append(np.frombuffer(r["vec"], np.float32 if len(r["vec"]) == 4 * dim else np.float64).astype(np.float64))
    enough = measure(forest, counts, x, [np.stack(near[int(i)]) if near[int(i)] else np.empty((0, dim)) for i in ids], recall)

    def candidates(batches):
        for b in batches:
            if not b.num_rows:
                continue
            i, leaf = b.column(0).to_numpy(), np.array(b.column(2).to_pylist())
            for t in range(trees):
                chunk = (i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[t][leaf[:, t]]
                yield sweep_batch(t << 40 | leaf[:, t], chunk, np.zeros(len(i), "i4"), i, np.ones(len(i), "i8"), b.column(1))

    def walks(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                x = unpacked(part.column(1), dim)
                margins = shared.value.margins(x)
                cell, chunk, row = [], [], []
                visited = np.zeros((len(x), trees, shared.value.leaves), bool)
                for q, m in enumerate(margins):
                    for t, leaf in shared.value.visit(m, counts, enough):
                        visited[q, t, leaf] = True
                        for c in range(blocks[t][leaf]):
                            cell.append(t << 40 | leaf)
                            chunk.append(c)
                            row.append(q)
                i = part.column(0).to_numpy()
                bars = np.full(len(i), -np.inf)
                of, leaves = anchors.value
                if len(of) > k:  # k + 1 of them, as a query's own row may be one
                    rough = x @ of.T
                    met = np.zeros(rough.shape, bool)
                    for t in range(trees):
                        met |= visited[:, t][:, leaves[:, t]]
                    rough[~met] = -np.inf
                    bars = np.partition(rough, len(of) - k - 1, axis=1)[:, len(of) - k - 1]
                for a in range(0, len(row), 4096):
                    r = np.array(row[a : a + 4096])
                    yield sweep_batch(cell[a : a + 4096], chunk[a : a + 4096], np.ones(len(r), "i4"), i[r], bars[r].view(np.int64), part.column(1).take(pa.array(r)))

    schema = "query_id long, id long, score double"
    dealt = indexed.mapInArrow(candidates, SWEEP).unionByName(vectors.where(asks).mapInArrow(walks, SWEEP))
    width = min(20_000, max(parts(spark, 0, 1), -(-int(counts.sum()) // BLOCK)))
    found = sweep(dealt, width, dim, _leaf_search(k), schema)
    return _best(found, k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % EVERY == 0)
