"""Operators against brute force on small tables with nulls, empty and repeated rows, ties and extra columns."""

import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import queries
from tallyline.llm.bpe import bpe
from tallyline.llm.jaccard_join import jaccard_join
from tallyline.llm.language_id import identify, train, words
from tallyline.llm.license_scan import license_scan
from tallyline.llm.lsh_forest import nearest
from tallyline.llm.mixing import mix, taken_text
from tallyline.llm.topk import exact_topk
from tallyline.llm.url_filter import url_filter

TOK = queries.vocabulary("").rstrip("/")
SF = "/root/testdata/sf0.001"


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name", ["op2_license_scan", "op3_url_filter", "op4_exact_topk", "op5_mixing", "op11_ranked_search", "op12_exact_dedup", "op13_conversation_trie"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    got = sorted(tuple(r[c] for c in order) for r in df.collect())
    want = sorted(tuple(r[list(rel.columns).index(c)] for c in order) for r in rel.fetchall())
    assert got == want


def test_bpe(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(f"{TOK}/word_bpe_49k.json")
    rng = random.Random(5)
    alphabet = "aAbB zé ÉßİΣς1²½٣'\n\t\x1c\x85日本!?.-_😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(200)] + ["", None, "x" * 3000, "<|endoftext|>a", "don't we'll"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in bpe(df, f"{TOK}/word_bpe_49k.json").collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == lib.decode(ids, skip_special_tokens=False)
    assert bpe(df.limit(0), f"{TOK}/word_bpe_49k.json").count() == 0


def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.round(rng.standard_normal((300, 8)), 2))]
    rows += [(300, rows[3][1]), (400, None), (500, [1.0, None] * 4), (600, [float("nan")] * 8), (700, [0.0] * 8), (800, [1.0, 2.0]), (900, [])]
    return rows, spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, label string")


def good(rows, zero):
    return [(i, np.array(v)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]


def test_topk(spark):
    rows, df = vectors(spark)
    got = sorted(tuple(r) for r in exact_topk(df, F.col("vec_id") % 20 == 0, k=5, block_rows=64).collect())
    want, vs = [], good(rows, True)
    for i, q in vs:
        if i % 20 == 0:
            s = sorted((-int(np.floor(64 * q) @ np.floor(64 * v)), j) for j, v in vs if j != i and len(v) == len(q))[:5]
            want += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    assert got == sorted(want)
    assert exact_topk(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest(spark):
    rows, df = vectors(spark)
    got = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0, k=5, enough=1600).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    vs, hit, total = good(rows, False), 0, 0
    for i, q in vs:
        if i % 50 == 0:
            s = sorted((float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in vs if j != i and len(v) == len(q))[:5]
            hit += len({j for _, j in s} & {j for _, j in got.get(i, [])})
            total += len(s)
    assert hit >= 0.9 * total
    assert nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_jaccard(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 80))] for _ in range(8)]
    rows = []
    for b in base:
        for _ in range(8):
            t = list(b)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(30)}"
            rows.append(" ".join(t))
    rows += ["", None, " \n", "One", "ONE", "one two three four", rows[0], "common line of seven words here now " + rows[9]]
    sets = {}
    for i, t in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    df = documents(spark, [(i, t, None, "s", 0) for i, t in enumerate(rows)] + [(None, rows[0], None, None, None), (0, rows[0], None, None, None)])
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(df).collect() if r.doc_id is not None)
    assert got == sorted([(i, len(s), label[i]) for i, s in sets.items()] + [(0, len(sets[0]), label[0])])
    assert jaccard_join(df.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 60)), None, rng.choice(["a", "b", "c", "d", None]), 0) for i in range(300)] + [(7, "w w", None, "a", 0), (None, "w", None, "a", 0), (1000, None, None, "b", 0), (1001, "x", None, "only", 0)]
    df = documents(spark, rows)
    quality = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    out = mix(df, quality)
    got = out.collect()
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(7), quality).collect()))
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        n, target = by.get(r.source, (0, r.target))
        by[r.source] = (n + r.taken, target)
    assert all(abs(n - target) <= 1 for n, target in by.values())
    assert abs(sum(t for _, t in by.values()) - 1.5 * sum(r.size for r in got)) < 1e-6
    assert sum(len(r.text.split()) for r in taken_text(out).collect()) == sum(r.taken for r in got)
    assert mix(df.limit(0), quality).count() == 0


def test_language(spark):
    path = f"{TOK}/piece_bpe_32k.model"
    rows = [(i, t, lang, "s", 0) for i, (lang, t) in enumerate([("en", "the house of the king and the river"), ("fr", "la maison de la reine et les rivières")] * 20)]
    model = train(documents(spark, rows), path)
    df = documents(spark, [(1, "the river and the house", None, None, 0), (2, "la reine et la maison", "en", None, 0), (3, None, None, None, None), (4, "12 !", None, None, 0), (5, "a" * 500, None, None, 0)])
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in identify(df, model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == ["en", "fr", "und", "und"] and all(0 <= s <= 1 for _, s in got.values())
    nothing = train(documents(spark, rows).limit(0), path)
    assert {r.lang_pred for r in identify(df, nothing).collect()} == {"und"}
    assert words("Ab c") == ["▁ab", "▁c"]


def test_license_and_url(spark):
    text = "Foo. Released under the\nMIT license! bar"
    df = documents(spark, [(1, text, None, None, 0), (1, text, None, None, 0), (2, None, None, None, 0), (3, "Released under MIT", None, None, 0), (None, text, None, None, 0)])
    assert sorted(map(tuple, license_scan(df).collect()), key=str) == [(1, "MIT", 1, 1), (None, "MIT", 1, 1)]
    entries = spark.sql("SELECT * FROM VALUES ('a', 'x.org', 'add', DATE'2024-01-02'), ('a', 'x.org', 'remove', DATE'2024-01-05'), ('b', 'Y.x.org', 'add', DATE'2024-01-01'), ('a', NULL, 'add', DATE'2024-01-01') t(list, host, action, dated)")
    caps = spark.sql("SELECT * FROM VALUES (1, 'http://y.X.org:80/p', DATE'2024-01-02'), (1, 'http://y.X.org:80/p', DATE'2024-01-02'), (2, 'https://x.org', DATE'2024-01-05'), (3, NULL, DATE'2024-01-02'), (4, 'http://ax.org/', DATE'2024-01-03'), (5, 'http://u@x.org./', DATE'2024-01-04'), (6, 'http://x.org', NULL) t(id, url, fetched_at)")
    got = sorted((r.id, r.blocked, r.lists) for r in url_filter(caps, entries).collect())
    assert got == [(1, True, "a,b"), (1, True, "a,b"), (2, False, ""), (3, False, ""), (4, False, ""), (5, True, "a"), (6, False, "")]
    assert url_filter(caps.limit(0), entries).count() == 0


@pytest.mark.skipif(not os.path.exists("corpus_pipeline.py"), reason="without the pipeline")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = corpus_pipeline.written(stage(spark, seen, SF))
        assert set(seen.columns) == set(docs.columns)
    want = seen.count()
    out = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert out.count() == want > 0 and out.where("n_tokens * 4 <> length(ids)").count() == 0


def test_sketches_never_differ_more_than_sets():
    import numpy as np

    from tallyline.llm.jaccard_join import differing, sketches

    rng = np.random.default_rng(3)
    for n, m, shared in ((1, 1, 0), (300, 250, 240), (3000, 2500, 2400), (5000, 4000, 10), (2, 2, 2)):
        pool = rng.integers(0, 1 << 63, n + m - shared, dtype=np.uint64)
        a, b = pool[:n], pool[n - shared :]
        s = sketches(np.concatenate((a, b)), np.repeat([0, 1], [n, m]), np.array([n, m])).to_pylist()
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        assert differing(*s) == differing(*s[::-1]) <= apart and (differing(*s) - apart) % 2 == 0
    assert sketches(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(2, np.int64)).to_pylist() == [bytes(32)] * 2
