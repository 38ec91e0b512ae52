"""Sums over segmentations, and their expectation step, against enumeration."""

import math

import numpy as np
import pytest

from tallyline.llm import language_id as L
from tallyline.llm.queries import vocabulary

VOCABULARY = ["▁", "a", "b", "▁a", "ab", "ba", "aab", "▁ab", "abab", "bbbbb"]


def ways(word):
    """All segmentations; a letter without a piece stands for itself."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in VOCABULARY or n == 1:
            yield from ([word[:n], *rest] for rest in ways(word[n:]))


def chance(way, prob):
    return math.prod(prob[VOCABULARY.index(p)] if p in VOCABULARY else L.UNKNOWN for p in way)


@pytest.fixture
def prob():
    p = np.random.default_rng(1).random((len(VOCABULARY) + 1, 2))
    p[-1] = 0
    return p / p.sum(axis=0)


def test_sums(prob):
    batch = ["▁", "▁a", "▁ab", "▁abab", "▁aabbb", "▁xab", "▁bbbbbab", "▁ababababx", "▁aaaaaaaaaa"]
    got = L.likelihoods(L.Lattice(VOCABULARY), batch, prob)
    for w, row in zip(batch, got, strict=True):
        for j in range(2):
            want = math.log(sum(chance(x, prob[:, j]) for x in ways(w))) + len(w) * math.log(L.SCALE)
            assert row[j] == pytest.approx(want)


def test_long_words_are_not_cut(prob):
    for word in ["▁" + "ab" * 3000, "▁" + "aab" * 31, "▁" + "x" * 500, "▁" + "b" * 47 + "ab"]:
        for j in range(2):
            log = [0.0]
            for end in range(1, len(word) + 1):
                terms = []
                for n in range(1, min(5, end) + 1):
                    piece = word[end - n : end]
                    if piece in VOCABULARY:
                        terms.append(log[end - n] + math.log(prob[VOCABULARY.index(piece), j]))
                    elif n == 1:
                        terms.append(log[end - n] + math.log(L.UNKNOWN))
                top = max(terms)
                log.append(top + math.log(sum(math.exp(t - top) for t in terms)))
            got = L.likelihoods(L.Lattice(VOCABULARY), [word, "▁a"], prob)[0, j]
            assert got == pytest.approx(log[-1] + len(word) * math.log(L.SCALE))


def test_expectation():
    counts = {"▁abab": 3, "▁aab": 1, "▁xbab": 2, "▁ba": 5, "▁" + "ab" * 4: 1}
    p = np.full(len(VOCABULARY), 1 / len(VOCABULARY))
    for _ in range(2):
        expected = np.full(len(VOCABULARY), L.EXTRA)
        for w, n in counts.items():
            each = [(x, chance(x, p)) for x in ways(w)]
            for x, c in each:
                for piece in x:
                    if piece in VOCABULARY:
                        expected[VOCABULARY.index(piece)] += n * c / sum(c for _, c in each)
        p = expected / expected.sum()
    assert L.fit(L.Lattice(VOCABULARY), counts)[:-1] == pytest.approx(p)


def test_four_languages_with_repeated_texts_are_learned(spark):
    rows = [(lang, f"{lang} text {i} {'abcdefgh'[i % 8] * (i % 5)}") for lang in ("en", "fr") for i in range(400)] + [("de", "der alte Fluss")] * 400 + [("es", "la casa vieja")] * 400 + [("zz", "12 34")]
    model = L.train(spark.createDataFrame(rows, "lang string, text string"), L_PATH)
    assert model.langs == ["de", "en", "es", "fr"]
    clashing = spark.createDataFrame([(1, "la casa", 5, "x"), (1, "la casa", 5, "x"), (None, "der Fluss", None, None), (3, "x" * 30000, 1, "y"), (4, "", 1, "z")], "doc_id long, text string, lang_pred int, Lang_Score string")
    got = sorted((str(r.doc_id), r.lang_pred) for r in L.identify(clashing, model).collect())
    assert [g for g in got if g[0] in ("1", "None")] == [("1", "es"), ("1", "es"), ("None", "de")] and ("4", "und") in got and len(got) == 5
    assert L.identify(clashing.limit(0), model).collect() == []


L_PATH = vocabulary("piece_bpe_32k.model")
