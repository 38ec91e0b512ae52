"""Queries whose vec_id has several vectors: the smallest one is asked with, wherever the rows lie."""

import numpy as np
from pyspark.sql import functions as F

from tallyline.llm.lsh_forest import nearest
from tallyline.llm.topk import exact_topk


def test_one_vector_asks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.round(rng.standard_normal((60, 6)), 2))]
    asks = {i: [[9.0 - i, 0.0, 1.0, 0.0, 0.0, 0.5], [-9.0, float(i), 0.0, 2.0, 0.0, 0.0], [5.0, 5.0]] for i in (0, 10, 20, 30, 40, 50)}
    rows = [(i, v) for i, v in rows if i not in asks] + [(i, v) for i, vs in asks.items() for v in vs]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(4)
        top = sorted(tuple(r) for r in exact_topk(df, F.col("vec_id") % 10 == 0, k=5, block_rows=16).collect())
        close = sorted(tuple(r) for r in nearest(df, F.col("vec_id") % 10 == 0, k=5, enough=4000).collect())
        want, near = [], []
        for i, vs in asks.items():
            q, others = np.array(min(vs)), [(j, np.array(v)) for j, v in rows if j != i and len(v) == len(min(vs))]
            s = sorted((-int(np.floor(64 * q) @ np.floor(64 * v)), j) for j, v in others)[:5]
            want += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
            s = sorted((float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in others)[:5]
            near += [(i, n + 1, j) for n, (_, j) in enumerate(s)]
        assert top == sorted(want)
        assert [t[:3] for t in close] == sorted(near)
