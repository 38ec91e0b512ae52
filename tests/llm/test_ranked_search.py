"""Ranked search against plain Python and SQL."""

import math
import random
import re
from collections import Counter

import pytest

from tallyline.llm import ranked_search as R
from tallyline.llm.queries import ORACLE_SQL


def words(text):
    low = (text or "").translate({a: a + 32 for a in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def expected(docs, items, k):
    all_words = [(i, words(t)) for i, t in docs]
    held = [(i, Counter(w)) for i, w in all_words if w]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def tables():
    rng = random.Random(8)
    vocabulary = ["a", "ab", "abc", "b", "Ba", "é", "É", "日本", "x1", "1"] + [f"w{i}" for i in range(60)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "\x00", "\t"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(300)] + [(None, text(10)), (5, text(8)), (7, "a b"), (7, "a b"), (301, None), (302, ""), (303, " .;"), (304, "a " * 200_000 + "w1"), (305, "same w2 w3"), (306, "same w2 w3")]
    items = [(i, text(rng.randint(1, 12))) for i in range(20)] + [(3, "w9 w10 abc"), (None, "w1 w2"), (50, None), (51, ""), (52, "nowhere at all"), (53, "SAME w2 w2 W3")]
    return docs, items


@pytest.mark.parametrize("few", [200_000, 2])
def test_same_as_python(spark, monkeypatch, few):
    monkeypatch.setattr(R, "FEW", few)
    docs, items = tables()
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, term string, n int, bucket int").repartition(5)
    q = spark.createDataFrame([(i, t, 4) for i, t in items], "item_id long, text string, rank int")
    assert sorted((tuple(r) for r in R.ranked_search(d, q, k=7).collect()), key=repr) == expected(docs, items, 7)
    index, asked = R.postings(d), R.written(R.asked_terms(q.where("item_id < 10")))
    assert sorted((tuple(r) for r in R.ranked(index, asked, 3).collect()), key=repr) == expected(docs, [x for x in items if x[0] is not None and x[0] < 10], 3)


def test_empty_tables(spark):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    assert R.ranked_search(d.limit(0), q).collect() == [] and R.ranked_search(d, q.limit(0)).collect() == []


def test_sql(spark, tmp_path):
    import duckdb

    docs, items = tables()
    con = duckdb.connect()
    for name, rows, schema in (("documents", docs, "doc_id long, text string"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).toPandas().to_parquet(tmp_path / f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({ORACLE_SQL['op11_ranked_search']})").fetchall()
    whole = lambda x: None if x is None or x != x else int(x)
    assert sorted((tuple(whole(v) for v in r) for r in got), key=repr) == expected(docs, items, 50)
