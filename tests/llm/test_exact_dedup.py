"""Exact dedup against plain Python: nulls, empty and long texts, repeated rows, poor fingerprints, clashing columns."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyline.llm.exact_dedup import exact_dedup, golomb, golomb_decoded


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**50), max_size=300), st.integers(0, 45))
def test_golomb(numbers, k):
    k = max(k, max(numbers, default=0).bit_length() - 12)
    gaps = np.array(numbers, np.uint64)
    assert golomb_decoded(*golomb(gaps, k), len(gaps), k).tolist() == numbers


def test_golomb_pieces():
    gaps = np.random.default_rng(1).integers(0, 1 << 20, 200_003).astype(np.uint64)
    for k in (0, 13, 17):
        assert np.array_equal(golomb_decoded(*golomb(gaps[: 500 if k == 0 else None], k), 500 if k == 0 else len(gaps), k), gaps[: 500 if k == 0 else None])


def rows():
    rng = random.Random(3)
    out = [(i, rng.choice("abcdefgh") * rng.randint(0, 4), i % 3) for i in range(400)]
    out += [(i, "hot", 0) for i in range(400, 700)] + [(i, f"alone {i}", 1) for i in range(700, 900)]
    out += [(900, None, 0), (901, "", 0), (None, "hot", 2), (None, "no id", 2), (None, "no id", 2), (910, "again", 1), (910, "again", 1), (910, "other", 1)]
    return out + [(920, "long " * 300_000, 0), (921, "long " * 300_000, 0), (922, "long " * 299_999 + "lonG ", 0), (930, "é", 0), (931, "é", 0)]


def expected(table):
    groups = {}
    for i, text, _ in table:
        groups.setdefault(text or "", []).append(i)
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == best and left
            left -= bool(kept)
            out.append((i, best, len(ids), bool(kept), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", ["whole", "few bits", "by length", "one value"])
def test_same_as_python(spark, how):
    table = rows()
    df = spark.createDataFrame(table, "doc_id long, text string, n int").repartition(7)
    more = {"whole": {}, "few bits": {"spare_bits": 0}, "by length": {"fingerprint": lambda t: F.length(t).cast("long"), "owner_rows": 16}, "one value": {"fingerprint": lambda t: F.lit(7).cast("long")}}[how]
    got = exact_dedup(df, **more).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=repr) == expected(table)


def test_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 5, "x", 1, 1, 2, "s", 9), (2, "a", 6, "y", 1, 1, 2, "s", 9)], "doc_id long, Text string, row long, content string, sender int, `whole` int, `words` int, `key` string, `Kept` int")
    out = exact_dedup(df)
    assert out.columns == ["doc_id", "Text", "row", "content", "sender", "whole", "words", "key", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((r.doc_id, r.row, r.content, r.kept) for r in out.collect()) == [(1, 5, "x", False), (2, 6, "y", True)]
    assert exact_dedup(df.limit(0)).collect() == []


def test_texts_of_single_documents_are_not_shuffled(spark):
    """Only suspects meet by their bytes; the rest is read where it lies."""
    df = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    plan = exact_dedup(df).where("group_size = 1")._jdf.queryExecution().executedPlan().toString()
    before_union = plan.split("Union")[1].split("SortMergeJoin")[0] if "SortMergeJoin" in plan else plan.split("Union")[1]
    assert "own_1" not in [w for line in before_union.splitlines() if "Exchange hash" in line for w in line.split()]
