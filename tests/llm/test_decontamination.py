"""Benchmark decontamination against SQL over whole tables and a plain comparison of word lists."""

import random

import duckdb
import pytest

from lumenfold.llm import decontamination as D

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, item_id string, spans int"  # extra columns with clashing names
ITEMS = "item_id long, text string, doc_id int"


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    rows = D.query(spark, SF)
    want = con.execute(D.ORACLE)
    assert rows.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, rows.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("block_bytes", [400_000, 60])
def test_equals_plain_in_one_and_in_many_blocks(spark, block_bytes):
    rng = random.Random(3)
    words = ["a", "b", "é", "ß7", "x"]
    line = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", " - ", "!"]) for _ in range(n))
    items = [(i, line(rng.choice([1, 2, 3, 4, 6]))) for i in range(10)] + [(3, "b b a"), (None, "x x x x"), (20, None), (21, ""), (22, " ?!")]
    texts = [line(rng.randint(0, 60)) for _ in range(40)] + [line(5000), None, "", "..", "A B", "😀 é".encode("utf-16", "surrogatepass").decode("utf-16")]
    docs = [(i // 2, t, "z", 1) for i, t in enumerate(texts)] + [(None, "a b", "z", 1)] * 2
    found = D.scanned(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame([(*x, 0) for x in items], ITEMS), size=3, block_bytes=block_bytes).collect()
    want = [(d, *D.plain(t, items, 3)) for d, t, *_ in docs]
    key = lambda r: str(r[:4])
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found], key=key) == sorted(want, key=key)


def test_spans_are_code_points_of_the_original(spark):
    text = "Üben — ONE,\ttwo  three; ένα one two"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = D.scanned(docs, spark.createDataFrame([(7, "one TWO three"), (8, "ένα")], "item_id long, text string")).first()
    assert [text[s.start : s.end] for s in row.spans] == ["ONE,\ttwo  three; ένα"]
    assert (row.n_words, row.n_hit, row["items"]) == (8, 4, ["7", "8"])


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert D.scanned(docs.limit(0), items).collect() == []
    row = D.digest(D.scanned(docs, items.limit(0))).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)
    assert row.items_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_windows():
    assert D.windows([b"a", b"b", b"c"], 2) == [[b"a", b"b"], [b"b", b"c"]]
    assert D.windows([b"a"], 2) == [[b"a"]] and D.windows([], 2) == []
