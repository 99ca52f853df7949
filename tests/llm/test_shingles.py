"""op2 against brute force, and the guarantee that linked sets share a signature."""

import random

import numpy as np
import pytest

from lumenfold.llm import shingle_join as sj

SF = "/root/testdata/sf0.001"


def plain_set(text):
    out, word = [], []
    for b in (text or "").encode("utf-8", "surrogatepass"):
        if b == 0x20 or 9 <= b <= 13:
            if word:
                out.append(bytes(word))
                word = []
        else:
            word.append(b + 32 if 65 <= b <= 90 else b)
    if word:
        out.append(bytes(word))
    if not out:
        return frozenset()
    return frozenset([tuple(out)] if len(out) < 5 else [tuple(out[i : i + 5]) for i in range(len(out) - 4)])


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    n = len(rows)
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    near = [set() for _ in range(n)]
    for i in range(n):
        for j in {j for x in sets[i] for j in where[x]}:
            if j != i and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    near[i].add(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((rows[i][0], len(sets[i]), min(rows[j][0] for j in seen) if rows[i][0] is not None else None))
    return out


def compare(got, rows):
    assert sorted((tuple(r) for r in got), key=str) == sorted(brute(rows), key=str)


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = [r.choice(words) for _ in range(60)]
    rows, k = [], 0

    def put(ws):
        nonlocal k
        rows.append((k * 7 % 10_007, " ".join(ws)))
        k += 1

    for _ in range(120):
        ws = [r.choice(words) for _ in range(int(r.choice([1, 3, 4, 5, 6, 9, 12, 20, 40, 80, 200, 700])))]
        if r.random() < 0.4:
            ws = ws[: len(ws) // 2] + passage + ws[len(ws) // 2 :]
        put(ws)
        for _ in range(r.choice([0, 0, 1, 3])):
            ws2 = list(ws)
            for _ in range(r.randint(0, max(1, len(ws) // 18))):
                i = r.randrange(len(ws2))
                ws2[i : i + 1] = r.choice([[], [r.choice(words)], [ws2[i], r.choice(words)]])
            put(ws2)
            ws = r.choice([ws, ws2])
    base = [r.choice(words) for _ in range(150)]
    for _ in range(60):  # a large group of near copies
        ws = list(base)
        ws[r.randrange(150)] = r.choice(words)
        put(ws)
    rows += [(20_001, None), (20_002, ""), (20_003, " \t\n"), (20_004, "A B"), (20_005, "a\vb"), (20_006, "é B c d e"), (20_007, "É b c d e"), (None, rows[0][1]), rows[3], rows[3], (20_008, "b a"), (20_009, "a b c d e f")]
    return rows


def test_join_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, h int, n int")
    compare(sj.join(df).drop("fp").collect(), rows)


def test_join_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sj, "BLOCK_SHINGLES", 900)
    rows = corpus(2)
    compare(sj.join(spark.createDataFrame(rows, "doc_id long, text string")).drop("fp").collect(), rows)


def test_query_over_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    compare(sj.query(spark, SF).collect(), rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sj.join(df).count() == 0 and sj.keep_one(df).count() == 0


def test_one_of_each_group_stays(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, row int")
    got = [(r.doc_id, r.text) for r in sj.keep_one(df).collect()]
    want = {(i, t) for (i, t), (_, n, c) in zip(rows, brute(rows), strict=True) if i is not None and c == i and n}
    assert sorted(x for x in got if x[0] is not None and plain_set(x[1])) == sorted(want)
    assert sorted((x for x in got if x[0] is None or not plain_set(x[1])), key=str) == sorted((x for x in rows if x[0] is None or not plain_set(x[1])), key=str)


@pytest.mark.parametrize("size", [5, 6, 7, 9, 10, 13, 19, 20, 41, 63, 64, 100, 141, 211, 500, 1067, 4000])
def test_linked_sets_share_signatures(size):
    rng = np.random.default_rng(size)
    for _ in range(30):
        s = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        drop = int(rng.integers(0, size // 5 + 1))
        add = 0
        while 100 * (size - drop) >= 80 * (size + add + 1):
            add += 1
        t = np.unique(np.concatenate([s[rng.permutation(size)[: size - drop]], rng.integers(0, 2**63, add, dtype=np.uint64)]))
        assert sj.linked(s, t)
        if len(s) == len(t) and (s == t).all():
            continue
        assert len(np.intersect1d(sj.signatures(s), sj.signatures(t)))


def test_one_text_a_set_however_many_rows(spark):
    """Many rows of one text beside a near copy: what is compared is one text for each of the two sets."""
    base = " ".join(f"w{i}" for i in range(400))
    docs = spark.range(10_000).selectExpr("if(id % 100 = 7, 7, id) as doc_id", f"if(id % 100 = 7, '{base} more', '{base}') as text").repartition(4)
    own = sj.sets(docs).where("doc_id in (0, 7)").groupBy("h").agg({"doc_id": "min"}).toDF("h", "doc_id")
    assert sj._texts(docs, own).count() == 2 and sj._filtered(docs, own).count() <= 8
    got = sj.join(docs).groupBy("component_id", "n_shingles").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 396, 9900), (0, 397, 100)]


def test_keep_one_takes_the_same_row_each_time(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, "a"), (1, words.upper(), "b"), (1, "  " + words, "c"), (2, words + " x", "d")]
    kept = [sj.keep_one(spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, lang string").repartition(k + 1)).collect() for k in range(3)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 1 and kept[0][0].doc_id == 1
