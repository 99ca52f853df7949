"""Near-duplicate vectors by an exact metric range join.

Cosine >= c means a distance of at most eps = sqrt(2 - 2c) between unit vectors. Pivots partition the vectors: each has
its home at the nearest. By the triangle inequality a vector x can only link to a home vector of pivot q if
d(x, q) <= eps + (radius of q's home), and only if x is within eps of the plane halfway between its own pivot and q; it is
replicated to those cells alone. A home vector then meets all its partners in its own cell, and cells join independently.
A cell with many home vectors is cut into blocks, each of which streams the cell's rows past it: nothing unbounded is held.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, remove, shared_dir, written
from .components import components
from .vectors import SWEEP, dimension, fingerprint, matrix, packed, sweep, sweep_batch, unit, unpacked, usable

COSINE = 0.95
#: Most pivots (they go to every task), and bytes of a block's home vectors in double precision. A cell has about a
#: block of them: the larger, the fewer copies of a vector are sent to other cells.
MOST_PIVOTS, BLOCK_BYTES = 4096, 16 << 20
#: Streamed rows that are compared with a block at a time, rows whose distances to all pivots are held at a time.
STREAMED, MEASURED = 512, 1024
#: Distance of pivots from which on rounding leaves the plane between them exact enough (about 1e-9).
APART = 1e-3
#: How far below the bound single precision may put a cosine that is above it.
_SLACK = 1e-4


def _classes(rows: DataFrame, dim: int) -> DataFrame:
    """vec_id, key (equal for equal vectors), vec."""

    def run(batches):
        for b in batches:
            x = matrix(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(r) for r in x], pa.string()), packed(x)], ["vec_id", "key", "vec"])

    return rows.select("vec_id", "embedding").mapInArrow(run, "vec_id long, key string, vec binary")


def block_rows(dim: int) -> int:
    """Home vectors of a block: 32,768 in 64 dimensions."""
    return max(1024, BLOCK_BYTES // (8 * dim))


def _distances(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * u @ pivots.T))


def _slices(batches):
    for b in batches:
        for i in range(0, b.num_rows, MEASURED):
            yield b.slice(i, MEASURED)


def _homes(classes: DataFrame, shared, dim: int) -> DataFrame:
    """shared: the broadcast pivots (as below)."""

    def run(batches):
        for b in _slices(batches):
            if b.num_rows:
                d = _distances(unit(unpacked(b.column(2), dim)), shared.value)
                home = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(home.astype("i4")), pa.array(d[np.arange(len(d)), home])], ["id", "n", "vec", "home", "d"])

    return classes.select("id", "n", "vec").mapInArrow(run, "id long, n long, vec binary, home int, d double")


def _spread(homes: DataFrame, shared, dim: int, p: int, eps: float, count: dict[int, int], radius: dict[int, float], block: int) -> DataFrame:
    """Rows of the sweep: each vector as part of a block at home, and streamed past all blocks of the cells it may link to."""
    blocks = np.array([max(1, -(-count.get(q, 0) // block)) for q in range(p)])
    reach = np.array([radius.get(q, -10.0) for q in range(p)]) + eps + 1e-7  # a radius near 0 is that inexact

    def run(batches):
        pivots = shared.value
        for b in _slices(batches):
            ids, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            home = b.column(3).to_numpy()
            d = _distances(unit(unpacked(b.column(2), dim)), pivots)
            own = d[np.arange(len(d)), home]
            homes_here, place = np.unique(home, return_inverse=True)
            between = _distances(pivots[homes_here], pivots)
            between[between < APART] = np.inf  # no plane between them: nothing is left out by it
            near = (d <= reach) & ((d * d - (own * own)[:, None]) / (2 * between[place]) <= eps + 1e-9)
            near[np.arange(len(d)), home] = True
            row, cell = np.nonzero(near)
            times = blocks[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            chunk = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            yield sweep_batch(home, (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[home], np.zeros(len(ids), "i4"), ids, n, b.column(2))
            for i in range(0, len(row), 4096):
                r = row[i : i + 4096]
                yield sweep_batch(cell[i : i + 4096], chunk[i : i + 4096], np.ones(len(r), "i4"), ids[r], n[r], b.column(2).take(pa.array(r)))

    return homes.mapInArrow(run, SWEEP)


def _linker(cosine: float):
    def make(ids: np.ndarray, n: np.ndarray, x: np.ndarray):
        """Block of home vectors; columns out: a, b (an edge, or a home vector and its own least), links of a."""
        u = unit(x)
        u32 = u.astype(np.float32)
        links = n - 1  # copies of itself
        parent = np.arange(len(ids))

        def root(k):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        def feed(oid, on, ox):
            found = [meet(oid[i : i + STREAMED], on[i : i + STREAMED], ox[i : i + STREAMED]) for i in range(0, len(oid), STREAMED)]
            found = [f for f in found if f]
            return [np.concatenate(c) for c in zip(*found, strict=True)] if found else []

        def meet(oid, on, ox):
            v = unit(ox)
            h, m = np.nonzero(u32 @ v.astype(np.float32).T >= cosine - _SLACK)
            for i in range(0, len(h), 100_000):  # the candidates again, in double precision
                part = slice(i, i + 100_000)
                h[part] = np.where((u[h[part]] * v[m[part]]).sum(axis=1) >= cosine, h[part], -1)
            fine = (h >= 0) & (ids[h] != oid[m])
            h, m = h[fine], m[fine]
            if not len(h):
                return []
            np.add.at(links, h, on[m])
            label = np.arange(len(ids))
            while True:  # least home vector over pairs that share a streamed one
                low = np.full(len(oid), len(ids))
                np.minimum.at(low, m, label[h])
                new = label.copy()
                np.minimum.at(new, h, low[m])
                new = new[new]
                if (new == label).all():
                    break
                label = new
            for k in np.flatnonzero(label != np.arange(len(ids))):
                a, b = root(k), root(label[k])
                parent[max(a, b)] = min(a, b)
            first = np.full(len(oid), -1)
            first[m[::-1]] = h[::-1]
            got = first >= 0
            return [oid[got], ids[first[got]], np.zeros(int(got.sum()), np.int64)]

        def finish():
            return [ids, ids[[root(k) for k in range(len(ids))]], links]

        return feed, finish

    return make


def near_duplicates(rows: DataFrame, cosine: float = COSINE, cell: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components link with nothing, as
    do rows without a vec_id. Equal vectors (repeated rows too) are one node of the join, weighted by how many they are, so
    thousands of copies cost one. Rows of one vec_id with several vectors count as one node with the links of all.
    Pivots are the vectors of the smallest hashes, about one for each `cell` vectors (a block's) and MOST_PIVOTS at most.
    """
    spark = rows.sparkSession
    folder = shared_dir(spark)
    dim = dimension(rows, "embedding")
    own = rows.select("vec_id", "embedding")
    if not dim:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    fit = usable("embedding") & (F.size("embedding") == dim) & F.col("vec_id").isNotNull()
    keyed = written(_classes(own.where(fit), dim), folder, "keyed")
    classes = written(keyed.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.min("vec").alias("vec")), folder, "classes")
    total = classes.count()
    block = block_rows(dim)
    want = min(MOST_PIVOTS, max(1, -(-total // (cell or block))))
    pivots = unit(np.stack([np.frombuffer(r["vec"], np.float32 if len(r["vec"]) == 4 * dim else np.float64).astype(np.float64) for r in classes.orderBy("key").limit(want).collect()])) if total else np.ones((1, dim))
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    shared = spark.sparkContext.broadcast(pivots)
    homes = written(_homes(classes, shared, dim), folder, "homes")
    stats = homes.groupBy("home").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect()  # one row a pivot
    dealt = _spread(homes, shared, dim, len(pivots), eps, {r["home"]: r["n"] for r in stats}, {r["home"]: r["r"] for r in stats}, block)
    width = max(parts(spark, 0, 1), sum(-(-r["n"] // block) for r in stats))
    joined = written(sweep(dealt, min(width, 20_000), dim, _linker(cosine), "a long, b long, links long"), folder, "links")
    links = joined.groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(joined.where("a != b").select("a", "b"), folder)
    nodes = classes.select("key", "id").join(links, F.col("id") == F.col("a"), "left").join(roots, F.col("id") == F.col("v"), "left").select("key", "links", F.coalesce("root", "id").alias("root"))
    nodes = written(nodes, folder, "nodes")
    remove(spark, folder, "classes", "homes", "links")
    linked = keyed.select("vec_id", "key").join(nodes, "key").select("vec_id", F.col("links").alias("n_links"), F.col("root").alias("component_id"))
    alone = own.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
u as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v),
links as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach as (select vec_id as a, vec_id as b from v union select r.a, l.b from reach r join links l on r.b = l.a)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, c.c as component_id, v.vec_id = c.c as kept
from v left join (select a, count(*) as n from links group by a) n on n.a = v.vec_id join (select a, min(b) as c from reach group by a) c on c.a = v.vec_id
"""
