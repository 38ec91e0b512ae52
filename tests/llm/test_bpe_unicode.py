"""All code points, and marks in any order, against the library."""

import random

import numpy as np

from tallyline.llm.bpe import Encoder
from tallyline.llm.queries import vocabulary


def same(texts):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    lib, mine = Tokenizer.from_file(path), Encoder(path)
    for a in range(0, len(texts), 20_000):
        part = texts[a : a + 20_000]
        for t, w, g in zip(part, lib.encode_batch(part, add_special_tokens=False), mine.encode(part), strict=True):
            assert np.frombuffer(g[0], "<u4").tolist() == w.ids and g[1].decode() == lib.decode(w.ids, skip_special_tokens=False), ascii(t)


def test_all_code_points():
    """Several of a kind in a text, with a letter and a digit beside each; private and unassigned planes by samples."""
    points = [c for c in [*range(0x34000), *range(0x34000, 0x110000, 997)] if not 0xD800 <= c < 0xE000]
    same(["".join(f"a{chr(c)}b1{chr(c)}. " for c in points[i : i + 8]) for i in range(0, len(points), 8)])


def test_marks():
    rng = random.Random(2)
    marks = [0x301, 0x316, 0x342, 0x345, 0x16FF1, 0x1193D, 0x61, 0x3B1, 0x1E944, 0x8D0, 0x898, 0x41, 0x30A, 0x3A3, 0x20]
    same(["".join(chr(rng.choice(marks)) for _ in range(rng.randint(1, 9))) for _ in range(5000)])
