"""One doc_id with several texts is several documents; columns that clash with results are replaced."""

import random
import re

from tallyline.llm.jaccard_join import jaccard_join
from tallyline.llm.substring_dedup import substring_dedup
from tallyline.llm.suffix_dedup import suffix_dedup


def texts():
    rng = random.Random(3)
    p, q = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(90)) for c in "pq")
    return p, q


def test_dedup(spark):
    p, q = texts()
    rows = [(1, p, 7, "a"), (2, q, 7, "b"), (2, "x " + p, 8, "c"), (2, "x " + p, 8, "c"), (None, p, 9, "d"), (5, None, 1, "e"), (5, "", 1, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept long, SPANS string").withColumnRenamed("SPANS", "N_removed")
    out = [(r.doc_id, r.text, r.n_removed, len(r.kept)) for r in suffix_dedup(df).collect()]
    assert len(out) == 7
    by = {(i, t): (n, k) for i, t, n, k in out}
    later = [n for (i, t), (n, _) in by.items() if i == 2 and t.startswith("x ")]
    assert by[2, q] == (0, len(q)) and by[1, p] == (0, len(p)) and later == [len(p)] and by[None, p] == (0, len(p))
    words = {(r.doc_id, r.text): r.n_removed for r in substring_dedup(df).collect()}
    assert words[2, q] == 0 and words[1, p] == 90 and words[2, "x " + p] == 90 and words[None, p] == 0


def test_links(spark):
    p, q = texts()
    df = spark.createDataFrame([(1, p, "a"), (2, q, "b"), (2, "x " + p, "c"), (4, q, "d"), (3, None, "e")], "doc_id long, text string, component_id string")
    sizes = len(re.findall(r"\S+", p)) - 4
    got = sorted(tuple(r) for r in jaccard_join(df).select("doc_id", "n_shingles", "component_id", "class_id").collect())
    assert got == sorted([(1, sizes, 1, 1), (2, sizes, 2, 2), (2, sizes + 1, 1, 2), (4, sizes, 2, 2), (3, 0, 3, 3)])
