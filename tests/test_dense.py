"""Vector search by blocks against all pairs."""

import numpy as np
import pytest

from lumenfold.operators import dense as D
from lumenfold.operators import retrieval as R


def same(a, b):
    """Equal ids and ranks, scores within rounding."""
    x, y = ({(r.query_id, r["rank"]): r for r in df.collect()} for df in (a, b))
    return x.keys() == y.keys() and all(x[k].vec_id == y[k].vec_id and abs(x[k].score - y[k].score) < 2e-6 for k in x)


@pytest.mark.parametrize("kept", [64_000_000, 0])
def test_equals_all_pairs(spark, monkeypatch, kept):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(400)] + [(i, [1.0, 2.0]) for i in range(400, 406)] + [(500, None), (501, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = df.where("vec_id % 7 = 0 and size(embedding) > 0").selectExpr("vec_id as query_id", "embedding as qvec").repartition(3)
    monkeypatch.setattr(D, "QUERY_BLOCK", 9)
    monkeypatch.setattr(D, "KEPT_BYTES", kept)
    for k in (1, 10):
        assert same(D.dense_top(asked, df, k), R.top(R.dense(asked, df).where("query_id <> vec_id"), "query_id", "vec_id", k))
    assert same(D.dense_top(asked, df, 3, False), R.top(R.dense(asked, df), "query_id", "vec_id", 3))


def test_vectors_with_nulls_take_no_part(spark):
    df = spark.createDataFrame([(1, [1.0, None]), (2, [1.0, 1.0]), (3, [2.0, 0.0]), (None, [9.0, 9.0])], "vec_id long, embedding array<double>")
    asked = df.where("vec_id = 2").selectExpr("vec_id as query_id", "embedding as qvec")
    assert [(r.vec_id, r["rank"]) for r in D.dense_top(asked, df, 5).collect()] == [(3, 1)]
    assert D.dense_top(asked.limit(0), df, 5).collect() == [] == D.dense_top(asked, df.limit(0), 5).collect()
