"""The threshold leaves few scores to be read to their end, and none of the best is lost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm.topk import exact_topk


def test_few_scores_are_resolved(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(c) for c in v], 7, 1.5) for i, v in enumerate(x)], "vec_id long, embedding array<double>, rank int, Score double")
    got = exact_topk(df, F.col("vec_id") % 100 == 0, k=5, block_rows=500, with_work=True).collect()
    assert max(r.resolved for r in got) < 600
    e = np.floor(64 * x)
    for q in range(0, 3000, 100):
        want = sorted((-int(e[q] @ e[j]), j) for j in range(3000) if j != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want


def test_components_too_large(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        exact_topk(df, F.col("vec_id") == 0).collect()
    big = spark.createDataFrame([(0, [2.0**20, 1.0]), (1, [2.0**22, 3.0]), (2, [-1.0, 2.0**23])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in exact_topk(big, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2**26 * 2**28 + 64 * 192), (2, -64 * 2**26 + 64 * 2**29)]
