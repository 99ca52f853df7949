"""Sketches merged from parts, and the page table function on rows the tables don't hold."""

import pytest

from lumenfold.functions import page_table
from lumenfold.operators import sketches as S


def test_parts_merge_to_the_whole(spark):
    rows = spark.range(60_000).selectExpr("id % 3 as k", "id div 20000 as day", "id % 7001 as who", "cast(id % 1000 as double) as v")
    keys = ["k"]
    whole = {r.k: r for r in S.estimated(S.sketched(rows, keys, "who", "v")).collect()}
    days = [S.merged(S.sketched(rows.where(f"day = {d}"), ["k", "day"], "who", "v"), keys) for d in range(3)]
    grown = days[0]
    for d in days[1:]:
        grown = S.merged(grown.unionByName(d), keys)
    for r in S.estimated(grown).collect():
        assert r.n == whole[r.k].n == 20_000
        assert abs(r.n_distinct - 7001) < 140 and abs(whole[r.k].n_distinct - 7001) < 140
        assert abs(r.quantile - 500) < 20 and abs(whole[r.k].quantile - 500) < 20


def test_pages_go_on_over_parts(spark):
    page_table.register(spark)
    rows = spark.createDataFrame([(1, 2, "c"), (1, 1, " a \n\n"), (2, 1, None), (3, 1, "x\ny")], "doc_id long, part int, text string")
    got = spark.sql("select * from page_table(table({rows}))", rows=rows).collect()
    assert sorted(map(tuple, got)) == [(1, 1, "a"), (1, 2, ""), (1, 3, ""), (1, 4, "c"), (2, 1, ""), (3, 1, "x"), (3, 2, "y")]
    with pytest.raises(Exception, match="page_table takes"):
        spark.sql("select * from page_table(table({rows}))", rows=rows.drop("part"))
