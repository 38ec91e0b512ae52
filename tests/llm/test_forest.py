"""The forest with its own settings: recall against brute force, how much it looks at, and how strings agree."""

import numpy as np
from pyspark.sql import functions as F

from tallyline.llm import lsh_forest as L


def test_few_are_looked_at_where_vectors_have_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 16)) * 4
    x = centres[rng.integers(0, 60, 3000)] + rng.standard_normal((3000, 16)) * 0.3
    x[1000:1400] = x[7]  # a group of equal vectors
    df = spark.createDataFrame([(i, [float(c) for c in v], 1, "s") for i, v in enumerate(x)], "vec_id long, embedding array<double>, rank int, Code string")
    got = L.nearest(df, F.col("vec_id") % 100 == 0, k=10, with_work=True).toPandas()
    hit = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        mine = got[got["query_id"] == q].sort_values("rank")
        assert len(mine) == 10 and mine["score"].tolist() == sorted(mine["score"]) == d[mine["vec_id"]].tolist()
        hit += len(set(np.lexsort((np.arange(3000), d))[:10]) & set(mine["vec_id"]))
    assert hit >= 0.9 * 300
    assert got.groupby("query_id")["looked"].first().mean() < 600
    equal = got[got["query_id"] == 1100].sort_values("rank")
    assert equal["vec_id"].tolist() == [7, *range(1000, 1009)] and set(equal["score"]) == {0.0}


def test_counted():
    rng = np.random.default_rng(1)
    code = np.sort(rng.integers(0, 1 << 63, 200, dtype=np.uint64) >> np.uint64(40))
    own = code[[3, 77]] ^ np.uint64(1)
    for who, bits, n in L.counted(0, code, None, None, np.array([5, 6]), own, None):
        for q, o in ((5, own[0]), (6, own[1])):
            want = [64 - int(c ^ o).bit_length() for c in code]
            assert {int(b): int(m) for w, b, m in zip(who, bits, n, strict=True) if w == q} == {b: want.count(b) for b in set(want)}


def test_numbers_keep_the_order_of_strings():
    s = np.array([0, 1, 1 << 63, (1 << 64) - 1, 12345678901234567890], np.uint64)
    assert (np.argsort(L.ordered(s)) == np.argsort(s)).all() and (L.string(L.ordered(s)) == s).all()
