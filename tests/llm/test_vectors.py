"""op3 and op9 against brute force; components against a plain search."""

import random

import numpy as np
import pytest

from lumenfold.llm import ann_forest, range_join
from lumenfold.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, n_links int"


def brute_links(ids, vectors, cosine=0.95):
    fit = [i for i, v in enumerate(vectors) if ids[i] is not None and v is not None and len(v) == DIM and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    u = {i: np.array(vectors[i], float) / np.linalg.norm(np.array(vectors[i], float)) for i in fit}
    links = {i: [j for j in fit if j != i and u[i] @ u[j] >= cosine] for i in fit}
    out = []
    for i in range(len(ids)):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min(ids[j] for j in seen) if ids[i] is not None else None
        out.append((ids[i], len(links.get(i, ())), c, ids[i] is not None and c == ids[i]))
    return out


DIM = 8


def planted(n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        v = rng.normal(size=DIM)
        rows.append(v)
        kind = rng.integers(6)
        if kind == 0:
            rows += [v] * int(rng.integers(1, 5))
        elif kind == 1:
            rows += [v + rng.normal(0, 0.07, DIM) * np.linalg.norm(v) for _ in range(int(rng.integers(1, 20)))]
        elif kind == 2:
            w = v
            for _ in range(6):
                w = w + rng.normal(0, 0.12, DIM) * np.linalg.norm(w)
                rows.append(w)
    return [[float(np.float32(x)) for x in v] for v in rows]


@pytest.mark.parametrize("cell", [20, 100_000])
def test_range_join_equals_brute_force(spark, cell):
    vectors = planted() + [None, [0.0] * DIM, [1.0] * (DIM - 1) + [None], [float("nan")] * DIM, [float("inf")] + [1.0] * (DIM - 1), [1.0] * (DIM + 1), []]
    ids = list(range(5, 5 + len(vectors)))
    random.Random(3).shuffle(ids)
    vectors.append(vectors[0])
    ids.append(None)
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in zip(ids, vectors)], SCHEMA)
    got = sorted((tuple(r) for r in range_join.near_duplicates(df, cell=cell).collect()), key=str)
    assert got == sorted(brute_links(ids, vectors), key=str)


def test_range_join_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(range_join, "block_rows", lambda dim: 30)
    base = np.random.default_rng(5).normal(size=DIM)
    vectors = [[float(x) for x in base + np.random.default_rng(k).normal(0, 0.15, DIM) * np.linalg.norm(base)] for k in range(200)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int, n_links int")
    got = sorted(tuple(r) for r in range_join.near_duplicates(df).collect())
    assert got == sorted(brute_links(list(range(200)), vectors))


def test_range_join_of_last_bit_copies(spark):
    rng = np.random.default_rng(5)
    base = np.array([1.0, 0.5, 0.25, 0.125, 1e-5, 2e-5, 3e-5, 4e-5], np.float32)
    copies = [[*map(float, base[:4]), *map(float, base[4:] + np.spacing(base[4:]) * rng.integers(-3, 4, 4).astype(np.float32))] for _ in range(80)]
    near = [[float(np.float32(x)) for x in base + rng.normal(0, 0.1, DIM)] for _ in range(60)]
    vectors = copies + near
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(vectors)], SCHEMA)
    for cell in (4, 20):
        assert sorted(tuple(r) for r in range_join.near_duplicates(df, cell=cell).collect()) == sorted(brute_links(list(range(len(vectors))), vectors))


@pytest.mark.parametrize("seed", [1, 2])
def test_range_join_of_parallel_vectors(spark, monkeypatch, seed):
    """Scalings of one vector all link to each other, also where the pivots have (nearly) one direction."""
    monkeypatch.setattr(range_join, "STREAMED", 7)
    monkeypatch.setattr(range_join, "MEASURED", 9)
    rng = np.random.default_rng(seed)
    base = rng.normal(size=DIM)
    scaled = [[float(x) for x in base * s] for s in rng.uniform(0.1, 9, 200)]
    turned = [[float(x) for x in (base + rng.normal(0, 10.0 ** -rng.integers(1, 9), DIM)) * s] for s in rng.uniform(0.1, 9, 60)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(scaled)], "vec_id long, embedding array<double>, label int, n_links int")
    assert {r.n_links for r in range_join.near_duplicates(df, cell=5).collect()} == {199}
    vectors = scaled[:60] + turned
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int, n_links int")
    assert sorted(tuple(r) for r in range_join.near_duplicates(df, cell=5).collect()) == sorted(brute_links(list(range(len(vectors))), vectors))


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert range_join.near_duplicates(df).count() == 0
    assert ann_forest.search(df, lambda i: i % 20 == 0).count() == 0
    df = spark.createDataFrame([(1, None, 0, 0), (0, [0.0, 0.0], 0, 0)], SCHEMA)
    assert sorted(tuple(r) for r in range_join.near_duplicates(df).collect()) == [(0, 0, 0, True), (1, 0, 1, True)]
    assert ann_forest.search(df, lambda i: i % 20 == 0).count() == 0


def truth(ids, x, k=20):
    out = {}
    for q in range(len(ids)):
        if ids[q] % 20 == 0:
            s = [(-(x[q] * x[c]).sum(), ids[c]) for c in range(len(ids)) if ids[c] != ids[q]]
            out[ids[q]] = [(i, -v) for v, i in sorted(s)[:k]]
    return out


def check_search(got, want):
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r)
    assert by.keys() == {q for q, w in want.items() if w}
    hits = total = 0
    for q, rows in by.items():
        assert [r["rank"] for r in rows] == list(range(1, len(want[q]) + 1))
        keys = [(-r.score, r.vec_id) for r in rows]
        assert keys == sorted(keys) and len({r.vec_id for r in rows}) == len(rows)
        hits += len({r.vec_id for r in rows} & {i for i, _ in want[q]})
        total += len(rows)
    return hits / total


def test_search_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann_forest, "LEAF", 64)
    monkeypatch.setattr(ann_forest, "BLOCK", 50)
    vectors = planted(2000, seed=2)
    vectors += [vectors[7]] * 60
    x = np.array(vectors)
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(vectors)] + [(100_000, None, 0, 0), (100_020, [0.0] * DIM, 0, 0)], SCHEMA)
    got = ann_forest.search(df, lambda i: i % 20 == 0).collect()
    want = truth(list(range(len(x))), x)
    assert check_search(got, want) >= 0.9
    exact = {(q, i): s for q, w in want.items() for i, s in w}
    assert all(r.score == (x[r.query_id] * x[r.vec_id]).sum() for r in got)
    assert exact


@pytest.mark.parametrize("anchors", [300, 8192])
def test_search_returns_rows_of_visited_leaves_alone(spark, monkeypatch, anchors):
    monkeypatch.setattr(ann_forest, "LEAF", 64)
    monkeypatch.setattr(ann_forest, "ANCHORS", anchors)
    x = np.array(planted(2000, seed=2))
    df = spark.createDataFrame([(i, [*map(float, v)], 0, 0) for i, v in enumerate(x)], SCHEMA)
    want = truth(list(range(len(x))), x)
    assert 0.9 <= check_search(ann_forest.search(df, lambda i: i % 20 == 0).collect(), want)
    monkeypatch.setattr(ann_forest, "measure", lambda *a: 1)  # one leaf a query
    assert check_search(ann_forest.search(df, lambda i: i % 20 == 0).collect(), want) < 0.9


def test_search_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0, 0), (20, [1.0, 0.0], 0, 0), (3, [2.0, 1.0], 0, 0), (3, [2.0, 1.0], 0, 0), (1, [2.0, 5.0], 0, 0)], SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann_forest.search(df, lambda i: i % 20 == 0).collect())
    assert got == [(0, 1, 1, 2.0), (0, 2, 3, 2.0), (0, 3, 20, 1.0), (20, 1, 1, 2.0), (20, 2, 3, 2.0), (20, 3, 0, 1.0)]


def test_trees_have_planes():
    assert [ann_forest.depth_for(n) for n in (0, 1, 40, 500, 2000, 100_000, 10**9)] == [0, 0, 0, 3, 4, 5, 11]


def visited_share(x, queries):
    """The share of leaves that the shared queue opens for the measured number of candidates."""
    forest = ann_forest.Forest(x, ann_forest.TREES, ann_forest.depth_for(len(x)))
    leaf = forest.assign(x)
    counts = np.stack([np.bincount(leaf[:, t], minlength=forest.leaves) for t in range(ann_forest.TREES)])
    near = [x[np.argsort(-(x @ x[q]), kind="stable")[:21]] for q in queries]
    enough = ann_forest.measure(forest, counts, x[queries], near, ann_forest.RECALL)
    return np.mean([len(forest.visit(m, counts, enough)) for m in forest.margins(x[queries])]) / counts.size


def test_search_of_clusters(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(200, 16)) * 3
    x = np.float32(centres[rng.integers(0, 200, 20_000)] + rng.normal(0, 0.3, (20_000, 16))).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [*map(float, v)]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, hits = ann_forest.search(df, lambda i: i % 400 == 0).collect(), 0
    for q in range(0, len(x), 400):
        order = np.argsort(-(x @ x[q]), kind="stable")
        hits += len({r.vec_id for r in got if r.query_id == q} & set(order[order != q][:20].tolist()))
    share = visited_share(x, range(0, len(x), 400))
    print("clusters: recall", hits / 1000, "share of leaves", share)
    assert len(got) == 50 * 20 and hits / 1000 >= 0.9 and share < 0.6


def test_search_over_a_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    want = truth([r.vec_id for r in rows], np.array([r.embedding for r in rows], float))
    got = ann_forest.query(spark, "/root/testdata/sf0.1").collect()
    assert check_search(got, want) >= 0.9


def test_components_equal_plain_search(spark, tmp_path):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(80)] + [(2000, 2000 + i) for i in range(1, 200)] + [(5, 5)]
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {v: find(v) for v in parent if find(v) != v}
    got = components(spark.createDataFrame([*edges, *edges[:9], (None, 3)], "a long, b long"), f"file://{tmp_path}")
    assert {r.v: r.root for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long"), f"file://{tmp_path}/e").count() == 0
