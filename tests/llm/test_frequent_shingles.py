"""Shingles that documents far apart share come last in the order, so that the holders of a passage do not all meet."""

import numpy as np

from tallyline.llm.jaccard_join import frequent, shingles


def test_passage_of_documents_in_different_blocks_is_frequent(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(d, f"{' '.join(f'w{d}x{i}' for i in range(150_000))} {passage}") for d in range(5)]
    assert min(len(t) for _, t in rows) > 1 << 20  # each document is a block of its own
    token, level = frequent(spark.createDataFrame(rows, "doc long, text string").coalesce(1), 5)
    want, _, _ = shingles([passage.encode()], 5)
    assert np.array_equal(token, want) and (level == 2).all()
