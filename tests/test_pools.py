"""Pools with all their members."""

from tessera.operators import records


def test_pools_hold_every_pair(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "a", ""), (4, "b", "x"), (5, "b", "x"), (6, None, "x"), (7, "a", "x")]
    items, queries = spark.createDataFrame(rows, "k long, d string, p string"), spark.createDataFrame([(2,), (7,), (3,), (9,)], "k long")
    got = [tuple(r) for r in records.pool_members(queries, items, ["d", "p"], "k").collect()]
    assert sorted(got) == [(1, 1, 3, False), (2, 1, 3, True), (7, 1, 3, True)]
    pairs = {(q, i) for q, a, _, asked in got for i, b, _, _ in got if asked and a == b}
    assert pairs == {(q, i) for q in (2, 7) for i in (1, 2, 7)}
