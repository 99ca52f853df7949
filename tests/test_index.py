"""The block index: same scores as the plain BM25 of all pairs, whatever the blocks; few bytes for few terms."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lumenfold.operators import index as I
from lumenfold.operators import retrieval as R

WORDS = [f"w{i}" for i in range(60)]


def corpus(spark, n=300, seed=1):
    rng = random.Random(seed)
    texts = [" ".join(WORDS[min(int(rng.expovariate(0.12)), 59)] for _ in range(rng.randint(0, 50))) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(n, None), (n + 1, ""), (n + 2, "w1 " * 4000), (n + 3, texts[3]), (n + 4, "Ünïque w1")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def queries(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.sample(WORDS, rng.randint(1, 12)))) for i in range(25)] + [(100, "w0 w0 W0"), (101, "nothing here"), (102, None), (103, "ünïque")]
    return spark.createDataFrame(rows, "item_id long, text string")


def plain(df):
    return sorted((r.item_id, r["rank"], r.doc_id, round(r.score, 5)) for r in df.collect())


@pytest.mark.parametrize(("docs_a_block", "terms_a_block", "first", "group"), [(4096, 4_000_000, 2, 512), (20, 4_000_000, 1, 512), (1000, 300, 2, 4), (1, 1, 1, 3)])
def test_equals_bm25_of_all_pairs(spark, tmp_path, monkeypatch, docs_a_block, terms_a_block, first, group):
    docs, asked = corpus(spark), queries(spark)
    monkeypatch.setattr(I, "FIRST", first)
    monkeypatch.setattr(I, "ONE_PASS", first)
    monkeypatch.setattr(I, "GROUP", group)
    I.write_index(docs, str(tmp_path / "i"), parts=5, block_docs=docs_a_block, block_terms=terms_a_block)
    own = I.Index(spark, str(tmp_path / "i"))
    assert own.n == 305
    assert plain(own.top(asked, 5)) == plain(R.top(R.bm25(asked, docs), "item_id", "doc_id", 5))


def test_terms_equal_counts(spark, tmp_path):
    docs = corpus(spark)
    I.write_index(docs, str(tmp_path / "i"), parts=3, block_docs=50)
    assert {tuple(r) for r in I.Index(spark, str(tmp_path / "i")).terms().collect()} == {tuple(r) for r in R.term_index(docs).collect()}


def test_a_frequent_term_is_split_by_block(spark, tmp_path):
    I.write_index(corpus(spark).coalesce(1), str(tmp_path / "i"), parts=3, block_docs=50)
    rows = spark.read.parquet(str(tmp_path / "i/postings")).where("term = 'w1'").select("block", "n").collect()
    assert len(rows) == 7 == len({r.block for r in rows}) and max(r.n for r in rows) <= 50


def bytes_read(df):
    """Bytes of the files that the scan of df opens, by its own metric."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collect()
    while not plan.metrics().contains("filesSize"):
        plan = plan.children().head()
    return plan.metrics().get("filesSize").get().value()


def test_few_terms_read_few_bytes(spark, tmp_path):
    I.write_index(corpus(spark, 2000), str(tmp_path / "i"), parts=32)
    own = I.Index(spark, str(tmp_path / "i"))
    _, buckets, _ = own.asked(queries(spark).where("item_id = 103"))
    found = own.postings(buckets).where("term = 'ünïque'")
    assert len(buckets) == 1 and found.count() == 1
    assert 0 < bytes_read(found) * 8 < bytes_read(own.rows.where("term = 'ünïque'"))
    assert own.postings([]).count() == 0


def test_lists_below_the_bar_bring_no_documents():
    rng = np.random.default_rng(0)
    for _ in range(50):
        lists = []
        for _ in range(6):
            docs = np.sort(rng.choice(200, rng.integers(1, 150), replace=False)).astype("<u4")
            w = rng.random(len(docs)) * rng.choice([0.1, 1, 3])
            lists.append((float(w.max()), docs, w))
        full = np.zeros(200)
        for _, d, w in lists:
            full[d] += w
        bar, total = float(np.sort(full)[-8]), np.zeros(200)
        found, score = I.best_of(lists, bar, 5, total)
        want = set(np.argsort(-full)[:5].tolist())
        assert want <= set(found.tolist()) and np.allclose(score, full[found]) and not total.any()
        assert len(I.best_of(lists, 100.0, 5, total)[0]) == 0


def test_an_empty_corpus(spark, tmp_path):
    I.write_index(corpus(spark).limit(0), str(tmp_path / "i"))
    own = I.Index(spark, str(tmp_path / "i"))
    assert own.n == 0 and own.top(queries(spark), 3).collect() == [] and own.terms().collect() == []


def test_a_changed_table_gets_a_new_index(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    corpus(spark).write.parquet(path)
    assert I.index_of(spark, path).n == I.index_of(spark, path).n == 305 and len([k for k in I._BUILT if path in str(k)]) == 1
    corpus(spark, 10).write.mode("overwrite").parquet(path)
    assert I.index_of(spark, path).n == 15


def test_a_block_is_built_in_few_bytes_a_term():
    import tracemalloc

    n, each = 2000, 300
    rng = np.random.default_rng(3)
    words = pa.array([f"w{x}" for x in rng.integers(0, 5000, n * each).tolist()])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * each + 1, each), pa.int32()), words)
    tracemalloc.start()
    rows = terms = 0
    for b in I._block(0, [pa.array(range(n))], [lists], pa.int64()):
        rows, terms = rows + b.num_rows, terms + sum(x or 0 for x in b["cf"].to_pylist()[b["term"].null_count :])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 5001 and terms == n * each and peak < 40 * n * each


def test_gold_comes_from_the_index(spark, tmp_path):
    from lumenfold.operators import evaluate

    docs = spark.createDataFrame([(1, "red fox runs"), (2, "a red fox sleeps"), (2, "red fox, once more"), (3, "fox red"), (4, None), (5, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "red fox"), (8, "fox red"), (9, "absent fox"), (10, "..."), (11, None)], "item_id long, text string")
    I.write_index(docs, str(tmp_path), 4, 2)
    own = I.Index(spark, str(tmp_path))
    assert sorted(map(tuple, evaluate.gold(items, docs, own).collect())) == [(7, 1), (7, 2), (7, 2), (8, 3)]
    asked = items.selectExpr("explode(array('red', 'sleeps', 'nowhere')) as term").distinct()
    assert sorted(map(tuple, own.counts_of(asked).collect())) == [("red", 4), ("sleeps", 1)]
    assert sorted(map(tuple, own.documents_of(asked).collect())) == [("red", 1), ("red", 2), ("red", 2), ("red", 3), ("sleeps", 2)]


def test_a_partition_of_terms_is_a_task_of_its_own(spark, tmp_path):
    I.write_index(corpus(spark), str(tmp_path / "i"), parts=16, block_docs=50)
    tasks = {p.name: {f.name.split("-")[1] for f in p.glob("part-*")} for p in (tmp_path / "i/postings").glob("part=*")}
    own = [t for name, t in tasks.items() if name != "part=-1"]
    assert len(own) > 10 and all(len(t) == 1 for t in own) and len(set.union(*own)) == len(own)
    assert len(tasks["part=-1"]) > 1


def test_rows_of_a_block_are_sorted():
    words = [["pear", "fig"], ["apple", "fig", "éclair"], [], ["fig"]]
    _, rows = I._block(0, [pa.array([5, 6, 7, 8])], [pa.array(words[:2]), pa.array(words[2:], pa.list_(pa.string()))], pa.int64())
    found = {t: (np.frombuffer(d, "<u4").tolist(), np.frombuffer(f, "<u4").tolist()) for t, d, f in zip(*(rows[c].to_pylist() for c in ("term", "docs", "tfs")), strict=True)}
    assert [*found] == ["apple", "fig", "pear", "éclair"]
    assert found == {"apple": ([1], [1]), "fig": ([0, 1, 3], [1, 1, 1]), "pear": ([0], [1]), "éclair": ([1], [1])}


def test_postings_are_read_once_for_a_query_set(spark, tmp_path):
    I.write_index(corpus(spark), str(tmp_path / "i"), parts=5)
    own, asked = I.Index(spark, str(tmp_path / "i")), queries(spark).where("item_id in (100, 101, 103)")
    plan = own.top(asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and not re.search(r"PartitionFilters: \[[^\]]*part#\d+ (IN|INSET) ", plan)
    few = own.narrowed(asked)
    assert few.narrowed(asked) is few and few.narrowed(queries(spark)) is not few
    assert {r.term for r in few.rows.collect()} == {"w0", "ünïque"}
    assert plain(few.top(asked, 5)) == plain(own.top(asked, 5)) != []
    assert plain(few.top(queries(spark), 5)) == plain(own.top(queries(spark), 5))
    assert plain(few.top(asked.where("item_id = 100"), 5)) == plain(own.top(asked.where("item_id = 100"), 5)) != []


def test_judged_lists_share_one_pass(spark, tmp_path, monkeypatch):
    from lumenfold.plans import dialogue

    texts = ["red fox runs", "a red fox sleeps", "red fox, once more", "fox red", None, "", "wolf"]
    spark.createDataFrame([*zip([1, 2, 2, 3, 4, 5, None], texts, strict=True)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "red fox"), (8, "fox red"), (9, "absent fox"), (10, "..."), (11, None), (None, "red")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    whole, opened = [], I.Index.postings
    monkeypatch.setattr(I.Index, "postings", lambda self, buckets: whole.append(self.only is None) or opened(self, buckets))
    ranked, relevant = dialogue.judged(spark, str(tmp_path))
    assert sum(whole) == 1
    assert sorted(map(tuple, relevant.collect())) == [(7, 1), (7, 2), (7, 2), (8, 3)]
    assert sorted((r.item_id, r.doc_id, r.rel) for r in ranked.collect()) == [(7, 1, 1), (7, 2, 1), (7, 2, 1), (7, 2, 1), (7, 2, 1), (7, 3, 0), (8, 1, 0), (8, 2, 0), (8, 2, 0), (8, 3, 1)]
    for df in (ranked, relevant):
        assert "Contains(" not in df._jdf.queryExecution().executedPlan().toString()  # written, not searched for again


def test_gold_shuffles_no_text_and_counts_once(spark, tmp_path, monkeypatch):
    from lumenfold.operators import evaluate

    texts = spark.createDataFrame([(1, "red fox runs"), (2, "a red fox sleeps"), (2, "red fox, once more"), (3, "fox red"), (4, None), (None, "red fox")], "doc_id long, text string")
    I.write_index(texts, str(tmp_path / "i"), 4)
    index = I.Index(spark, str(tmp_path / "i"))
    items = spark.createDataFrame([(7, "red fox"), (7, "fox red"), (8, "runs"), (None, "red"), (9, None)], "item_id long, text string")
    wide = texts.unionByName(spark.range(100, 10**6).selectExpr("id as doc_id", "repeat('x ', 500) as text"))  # too large to be broadcast
    wanted = []
    monkeypatch.setattr(I.Index, "documents_of", lambda self, asked, of=I.Index.documents_of: wanted.append(asked) or of(self, asked))
    found = evaluate.gold(items, wide, index)
    assert "hashpartitioning(doc_id" not in found._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in " ".join(wanted[0].inputFiles())
    assert {r.term for r in wanted[0].collect()} == {"fox", "red", "runs"}
    assert sorted(map(tuple, found.collect())) == [(7, 1), (7, 2), (7, 2), (7, 3), (8, 1)]
