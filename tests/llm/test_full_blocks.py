"""How many blocks the forest has follows from the vectors, not from how a shuffle deals them out."""

import numpy as np

from tallyline.llm.lsh_forest import entries


def test_blocks_are_full_whatever_the_partitions(spark):
    x = np.random.default_rng(5).standard_normal((600, 4))
    x[100:150] = x[3]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        got = entries(df, 10, 4096).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == 1
    first, ids, data = (np.frombuffer(got[0][c], t) for c, t in (("first", np.int64), ("ids", np.int64), ("data", float)))
    assert len(first) == 551 and data.shape == (550 * 4,)
    for v, a, b in zip(data.reshape(-1, 4), first[:-1], first[1:], strict=True):
        assert ids[a:b].tolist() == np.flatnonzero((x == v).all(axis=1))[:11].tolist()
