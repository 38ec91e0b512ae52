"""Columns that bear an operator's own names, empty tables, long texts and long lists."""

import pytest
from pyspark.sql import functions as F

from tallyline.llm import url_filter as U
from tallyline.llm.bpe import bpe
from tallyline.llm.jaccard_join import one_of_each
from tallyline.llm.language_id import identify, train
from tallyline.llm.license_scan import license_scan
from tallyline.llm.mixing import mix, taken_text
from tallyline.llm.queries import vocabulary


def test_mix_and_taken_text(spark):
    rows = [(i, "w " * (i % 7) + "end", "ab"[i % 2], i, "n", 1.5, 2, 3, 4, 5) for i in range(60)] + [(None, f"no id {i} at all", "a", 0, "n", 1.0, 2, 3, 4, 5) for i in range(20)] + [(99, "long " * 200_000, "b", 0, "n", 1.0, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rows long, name string, grade double, number long, offset long, whole long, Copy long").withColumn("Taken", F.lit("x"))
    quality = spark.createDataFrame([], "doc_id long, quality int")
    out = mix(df, quality)
    assert set(df.columns) - set(out.columns) == {"Taken"} and out.where("rows > 0 AND name = 'n' AND number = 2").count() == 59
    got = out.collect()
    assert len({r.taken for r in got if r.doc_id is None}) >= 1 and all(0 <= r.taken <= 2 * r.size for r in got)
    texts = taken_text(out)
    assert set(texts.columns) == set(df.columns) - {"Taken"}
    assert sum(len(r.text.split()) for r in texts.collect()) == sum(r.taken for r in got)


@pytest.mark.parametrize("few", [100_000, 1])
def test_url_filter(spark, monkeypatch, few):
    monkeypatch.setattr(U, "FEW", few)
    entries = spark.sql("SELECT * FROM VALUES ('a', 'x.org', 'add', DATE'2024-01-02'), ('b', 'org', 'add', DATE'2024-01-03'), ('a', 'z.com', 'add', DATE'2024-01-01') t(list, host, action, dated)")
    caps = spark.sql("SELECT id, url, at AS fetched_at, 'q' AS asked, 1 AS name, 2 AS salt, 'h' AS Host, 3 AS since FROM VALUES (1, 'http://y.x.org/', DATE'2024-01-04'), (2, 'http://y.com/', DATE'2024-01-04'), (3, concat('http://a.x.org/', repeat('p', 100000)), DATE'2024-01-02') t(id, url, at)")
    out = U.url_filter(caps, entries)
    assert out.columns == ["id", "url", "fetched_at", "asked", "name", "salt", "since", "host", "blocked", "lists"]
    assert sorted((r.id, r.host, r.lists) for r in out.collect()) == [(1, "y.x.org", "a,b"), (2, "y.com", ""), (3, "a.x.org", "a")]
    assert U.url_filter(caps, entries.limit(0)).where("blocked").count() == 0


def test_license_scan(spark):
    rows = [(1, "word " * 20_000 + "Released under the MIT License.", "key", 1, 2), (2, "", "key", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, span int, w int")
    assert [(r.doc_id, r.license) for r in license_scan(df).collect()] == [(1, "MIT")]
    assert license_scan(df.limit(0)).collect() == []


def test_mix_nulls_are_told_apart(spark):
    """Rows that are equal but for which of their columns is null."""
    rows = [(1, None, "a b c"), (1, "a b c", None), (2, "s", "w " * 10), (None, "s", "1"), (None, None, "s"), (None, "s", None), (3, None, None), (3, None, None)]
    out = mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert sorted(((r.doc_id, r.source, r.text) for r in out), key=repr) == sorted(rows, key=repr)
    assert all(r["size"] == len((r.text or "").split()) for r in out)


def test_bpe_and_language_columns(spark):
    rows = [(1, "hello there", 5, 6, "x", "y", 0.5), (1, None, 5, 6, "x", "y", 0.5), (2, "word " * 100_000, 5, 6, "x", "y", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS int, N_tokens int, Decoded string, Lang_pred string, LANG_SCORE double")
    out = bpe(df, vocabulary("word_bpe_49k.json"))
    assert out.columns == ["doc_id", "text", "Lang_pred", "LANG_SCORE", "n_tokens", "ids", "decoded"]
    assert sorted(r.n_tokens for r in out.collect())[0] == 0
    labelled = spark.createDataFrame([("hello there you", "en"), ("bonjour tout le monde", "fr")], "text string, lang string")
    out = identify(df, train(labelled, vocabulary("piece_bpe_32k.model")))
    assert out.columns == ["doc_id", "text", "IDS", "N_tokens", "Decoded", "lang_pred", "lang_score"]
    assert sorted(r.lang_pred for r in out.collect())[-1] == "und"


def test_one_of_each_columns(spark):
    rows = [(1, "one two three", "t", 9), (1, "other text here", "t", 9), (2, "one two three", "t", 9), (None, "one two three", "t", 9), (3, "one two three", "u", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_digest string, row_of_id int").withColumn("digest", F.lit(1)).withColumn("place", F.lit(2))
    out = one_of_each(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, "one two three"), (1, "other text here"), (None, "one two three")], key=repr)
