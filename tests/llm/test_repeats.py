"""Word and byte deduplication against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyline.llm.substring_dedup import substring_dedup
from tallyline.llm.suffix_dedup import suffix_array, suffix_dedup


@pytest.mark.parametrize("alphabet", [1, 2, 4, 200])
def test_suffix_array(alphabet):
    rng = random.Random(alphabet)
    for _ in range(60):
        b = bytes(rng.randrange(alphabet) for _ in range(rng.randint(1, 150)))
        assert list(suffix_array(np.frombuffer(b, np.uint8))) == sorted(range(len(b)), key=lambda i: b[i:])


def corpus():
    rng = random.Random(7)
    word = lambda: rng.choice(["stone", "règle", "a", "under", "日本", "Of", "x1"]) + str(rng.randrange(400))
    passage, line = " ".join(word() for _ in range(60)), " ".join(word() for _ in range(30))
    rows = [" ".join(word() for _ in range(rng.randint(0, 120))) for _ in range(40)]
    rows += [f"{rows[i]} {passage}\n{rows[i + 1]}" for i in range(20)]
    rows += [f"{word()} {line} {word()} {word()}" for _ in range(60)]  # a common line, all contexts distinct
    rows += [rows[3], rows[3], rows[45], passage * 3, "ab" * 300, "ab" * 300, "", "   ", None, "z" * 99, "z" * 101, "\t".join(["w"] * 90)]
    return list(enumerate(rows))


def brute_bytes(rows, n):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        cov = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                cov[p : p + n] = b"\1" * n
            seen.add(b[p : p + n])
        out[i] = (len(b), sum(cov), len(re.findall(b"\1+", bytes(cov))), bytes(x for x, c in zip(b, cov, strict=True) if not c))
    return out


def brute_words(rows, n):
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for i, t in rows}
    seen = Counter(tuple(w[p : p + n]) for w in words.values() for p in range(len(w) - n + 1))
    out = {}
    for i, w in words.items():
        cov = [False] * len(w)
        for p in range(len(w) - n + 1):
            if seen[tuple(w[p : p + n])] > 1:
                cov[p : p + n] = [True] * n
        out[i] = (len(w), sum(cov), b" ".join(x for x, c in zip(w, cov, strict=True) if not c))
    return out


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "x", 5, 1.5) for i, t in rows], "doc_id long, text string, spans string, key int, n double").repartition(parts)


@pytest.mark.parametrize("spread", [16, 1])
def test_bytes(spark, monkeypatch, spread):
    monkeypatch.setattr("tallyline.llm.repeats.SPREAD", spread)
    got = {r.doc_id: (r.n_units, r.n_removed, len(r.removed_spans), bytes(r.kept)) for r in suffix_dedup(frame(spark, corpus())).collect()}
    assert got == brute_bytes(corpus(), 100)


@pytest.mark.parametrize("group", [4096, 2])
def test_words(spark, monkeypatch, group):
    monkeypatch.setattr("tallyline.llm.repeats.GROUP", group)
    got = {r.doc_id: (r.n_units, r.n_removed, bytes(r.kept)) for r in substring_dedup(frame(spark, corpus()), 35, 12).collect()}
    assert got == brute_words(corpus(), 35)


def test_edges(spark):
    for op in (suffix_dedup, substring_dedup):
        assert op(frame(spark, []).limit(0)).collect() == []
        twice = frame(spark, [(1, "q " * 80), (1, "q " * 80), (None, "q " * 80)])
        got = {(r.doc_id, r.n_removed) for r in op(twice).collect()}
        assert (None, 0) in got and len(got) == 2


def test_large_suffix_array_recurses():
    """Reduced texts of very many names are sorted by the recursion, too."""
    from tallyline.llm import suffix_dedup as S

    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    b = " ".join(rng.choice(words) for _ in range(150_000)).encode()[:1_000_000]
    depth, names, sort = [], [], S.suffix_array

    def watched(s, sigma=256):
        depth.append(len(s))
        names.append(sigma)
        return sort(s, sigma)

    S.suffix_array = watched
    try:
        sa = watched(np.frombuffer(b, np.uint8))
    finally:
        S.suffix_array = sort
    assert len(depth) > 2 and depth[1] > 200_000 and max(names) > 2048
    assert len(set(sa.tolist())) == len(b)
    rank = np.empty(len(b) + 1, np.int64)
    rank[sa], rank[len(b)] = np.arange(len(b)), -1
    i, j = sa[:-1], sa[1:]
    text = np.frombuffer(b, np.uint8)
    assert ((text[i] < text[j]) | ((text[i] == text[j]) & (rank[i + 1] < rank[j + 1]))).all()


@pytest.mark.parametrize("alphabet", [1, 2, 4, 200])
def test_common_prefixes(alphabet):
    from tallyline.llm.suffix_dedup import common_prefixes

    rng = random.Random(alphabet)
    for _ in range(60):
        b = bytes(rng.randrange(alphabet) for _ in range(rng.randint(1, 60))) * rng.randint(1, 3)
        sa = suffix_array(np.frombuffer(b, np.uint8))
        got = common_prefixes(np.frombuffer(b, np.uint8), sa)
        for k, i in enumerate(sa):
            j = sa[k - 1] if k else i
            want = next((w for w in range(len(b)) if max(i, j) + w >= len(b) or b[i + w] != b[j + w]), len(b)) if k else 0
            assert got[i] == want
