"""Near duplicates by stars against a comparison of all pairs."""

import random

import numpy as np
import pytest

from lumenfold.operators import near
from lumenfold.operators import near as N


def sets_of(texts, n=N.WORDS):
    out = {}
    for d, t in texts:
        w = (t or "").lower().split()
        out[d] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    return out


def brute(texts, similarity):
    own = sets_of(texts)
    least = {}
    for d in sorted(own):
        least.setdefault(own[d], d)
    rows = []
    for d, s in own.items():
        links = sum(1 for x in least if x and x != s and len(s & x) >= similarity * len(s | x) - 1e-9) if s else 0
        rows.append((d, least[s] if s else d, links))
    return sorted(rows)


def texts(seed=4, families=12, each=14):
    rng = random.Random(seed)
    out = []
    for _ in range(families):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 40, 90, 200]))]
        for _ in range(each):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(30)}"
            out.append(" ".join(own + [f"y{i}" for i in range(rng.choice([0, 0, 3, 20]))]))
    return list(enumerate(out)) + [(9000, None), (9001, ""), (9002, " ?! "), (9003, "one")]


@pytest.mark.parametrize(("similarity", "block"), [(0.8, 256), (0.7, 3)])
@pytest.mark.parametrize("buckets", [N.prefix_buckets, N.band_buckets])
def test_equals_all_pairs(spark, monkeypatch, similarity, block, buckets):
    monkeypatch.setattr(N.links_by_stars, "__defaults__", (block,))
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(map(tuple, N.near_duplicates(docs, similarity, buckets).collect()))
    assert found == brute(rows, similarity) and sum(r[2] for r in found) > 50


def test_copies_cost_their_rows(spark, tmp_path):
    """Many copies of two near texts: two classes, each sent once."""
    a = " ".join(f"w{i}" for i in range(100))
    docs = spark.range(20_000).selectExpr("id as doc_id", f"case when id % 2 = 0 then '{a}' else '{a} more' end as text")
    found = N.near_duplicates(docs)
    assert {(r.class_id, r.n_links) for r in found.collect()} == {(0, 1), (1, 1)} and found.count() == 20_000
    sets = N.packed_sets(docs.limit(2))
    classes = sets.selectExpr("doc_id as class_id", "packed")
    assert N.links_by_stars(classes, N.band_buckets(classes, 0.8), 0.8, str(tmp_path)).count() == 2


def test_bands_reach_the_recall():
    for s in (0.5, 0.7, 0.8, 0.95):
        b = N.bands_for(s)
        assert (1 - s**N.BAND_ROWS) ** b <= N.MISSED < (1 - s**N.BAND_ROWS) ** (b - 1)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000, np.uint64)
    sets = [np.sort(x[:2000]), np.sort(x[400:2400]), np.sort(x[1500:])]
    keys = N.signatures(np.concatenate(sets), np.cumsum([0, 2000, 2000]), 600, 1)
    same = lambda i, j: float((keys[i] == keys[j]).mean())
    assert abs(same(0, 1) - 1600 / 2400) < 0.06 and abs(same(0, 2) - 500 / 3000) < 0.06


def test_shingles_of_short_and_empty_texts():
    doc, h = N.shingle_hashes(np.arange(1, 8, dtype=np.uint64), np.array([0, 1, 0, 6]))
    assert doc.tolist() == [1, 3, 3] and len(set(h.tolist())) == 3
    assert len(N.shingle_hashes(np.zeros(0, np.uint64), np.array([0, 0]))[0]) == 0


def test_prefixes_share_a_hash_whatever_the_counts():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = rng.integers(0, 1 << 63, n, np.uint64)
        b = np.concatenate([a[: n - int(rng.integers(0, n // 5 + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, 8)), np.uint64)])
        counts = rng.integers(0, 3, near.CELLS)
        owner, h = near.prefix(np.concatenate([a, b]), np.array([len(a), len(b)]), counts, 0.8)
        both = len(np.intersect1d(a, b))
        assert (owner == 0).sum() == n - int(np.ceil(0.8 * n - 1e-9)) + 1
        if both >= 0.8 * (len(np.union1d(a, b))):
            assert set(h[owner == 0].tolist()) & set(h[owner == 1].tolist())


def test_shingles_are_not_shuffled_to_find_prefixes(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 2) * 50 + j}" for j in range(40)) + f" x{i}") for i in range(40)], "doc_id long, text string")
    classes = near.packed_sets(docs).selectExpr("doc_id as class_id", "packed")
    found = near.prefix_buckets(classes, 0.8)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 40 * (37 - 30 + 1)


def test_minhash_makes_its_shingles_once(spark):
    from lumenfold.operators import ingest

    docs = spark.createDataFrame([(1, "A b c"), (2, ""), (3, None), (4, " .,- ")], "doc_id long, text string")
    found = ingest.minhash(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert sorted((r.doc_id, r.seed) for r in found.collect()) == [(1, 0), (1, 1), (1, 2), (1, 3)]


def written(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_sets_are_not_written(spark, tmp_path, monkeypatch):
    """What near_duplicates keeps is a digest and a sketch of a set, not its eight bytes a shingle."""
    monkeypatch.setattr(near, "shared_folder", lambda session, name: str(tmp_path))
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(1500))) for i in range(150)]
    assert N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).count() == 150
    assert 0 < written(tmp_path) < 150 * 1496 * 8 / 4


def test_only_classes_that_may_be_alike_meet_on_their_sets(spark, tmp_path):
    """A bucket that brings everything together: sketches keep apart what isn't alike, and lose no link."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400, np.uint64)
    sets = [np.sort(rng.integers(0, 1 << 63, int(n), np.uint64)) for n in rng.integers(1, 900, 60)]
    sets += [np.sort(np.append(base[: 400 - k], rng.integers(0, 1 << 63, k, np.uint64))) for k in range(0, 100, 4)]
    classes = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "class_id long, packed binary")
    buckets = classes.selectExpr("class_id", "explode(array(1L, class_id % 3 + 2)) as bucket")
    found = {r.class_id: r.n_links for r in N.links_by_stars(classes, buckets, 0.8, str(tmp_path), 20).collect() if r.n_links}
    like = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
    asked = {i: sum(like(x, y) for j, y in enumerate(sets) if j != i) for i, x in enumerate(sets)}
    assert found == {i: n for i, n in asked.items() if n} and len(found) > 10
    assert {r.class_id for r in spark.read.parquet(str(tmp_path / "near")).select("class_id").collect()} <= set(range(60, 85))


@pytest.mark.parametrize("similarity", [0.3, 0.8, 1.0])
def test_sketches_lose_no_pair(similarity):
    rng = np.random.default_rng(6)
    sets = []
    for n in (1, 2, 5, 63, 64, 65, 130, 1000):
        x = rng.integers(0, 1 << 63, n, np.uint64)
        sets += [x, x.copy()] + [np.append(x[: n - int(n * k)], rng.integers(0, 1 << 63, int(n * j), np.uint64)) for k, j in ((0, 0.1), (0.1, 0), (0.1, 0.1), (0.2, 0), (0, 0.25), (0.11, 0.12), (0.6, 0))]
    sizes, every = np.array([len(x) for x in sets]), ~np.eye(len(sets), dtype=bool)
    found = N.alike(sizes, [N.sketch(x) for x in sets], every, similarity)
    like = np.array([[len(np.intersect1d(a, b)) >= similarity * len(np.union1d(a, b)) - 1e-9 for b in sets] for a in sets]) & every
    assert (found == found.T).all() and not (like & ~found).any() and found.sum() < every.sum() / 2
    assert not (N.alike(sizes, [N.sketch(x) for x in sets], like, similarity) & ~like).any()


def test_copies_that_marks_let_through(spark, monkeypatch):
    """Marks as coarse as can be: a class is found again by its own document, whatever copies come before it."""
    monkeypatch.setattr(near, "_MARKS", 64)
    some = [t for _, t in texts(families=3, each=8) if t and t.strip(" ?!")]
    rows = [(100 - i, t) for i, t in enumerate(some)] + [(200 + i, t) for i, t in enumerate(some)]
    docs = spark.createDataFrame(sorted(rows, reverse=True) + [(None, rows[0][1])], "doc_id long, text string").repartition(2)
    found = sorted(map(tuple, N.near_duplicates(docs).where("doc_id is not null").collect()))
    assert found == brute(rows, 0.8) and sum(r[2] for r in found) > 10
