"""Which fragments of an anchor need a suffix array: all that share a window, few of those that share only the anchor."""

import random

import numpy as np
import pytest

from tallyline.llm.repeats import Units
from tallyline.llm.suffix_dedup import may_meet, shard


def fragments(seed: int, u: Units) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Fragments that agree around their anchors by chance, as far as they agree with the one they are made from."""
    rng = random.Random(seed)
    key, left, frags = [], [], []
    for k in range(40):
        anchor, before, behind = (bytes(rng.choices(b"abcdefgh", k=n)) for n in (u.gram, u.slack, u.slack))
        for _ in range(rng.randint(1, 6)):
            a, b = rng.randint(0, u.slack), rng.randint(0, u.slack)
            x, y = before[u.slack - a :] if rng.random() < 0.5 else b"#" + bytes(rng.choices(b"xyz", k=u.slack)) + before[u.slack - a :], behind[:b] + bytes(rng.choices(b"uvw", k=u.slack - b))
            x = x[-u.slack :]
            key, left, frags = [*key, k], [*left, len(x)], [*frags, x + anchor + y]
    return np.array(key, np.uint64), np.array(left), frags


@pytest.mark.parametrize("length,gram", [(100, 32), (12, 4), (6, 5), (5, 5)])
def test_no_shared_window_is_lost(length, gram):
    u = Units(False, length, gram, True)
    for seed in range(20):
        key, left, frags = fragments(seed, u)
        doc, pos = np.arange(len(frags)), np.zeros(len(frags), np.int64)
        stay = may_meet(key, left, frags, u)
        every = set(zip(*(x.tolist() for x in shard(key, left, doc, pos, frags, u)), strict=True))
        few = [f for f, s in zip(frags, stay, strict=True) if s]
        got = set(zip(*(x.tolist() for x in shard(key[stay], left[stay], doc[stay], pos[stay], few, u)), strict=True)) if few else set()
        # Windows that do not hold the anchor at its place are of no key; the rest must all be found.
        with_anchor = {(d, p) for d, p in every if p <= left[d] and p + length >= left[d] + gram}
        assert with_anchor <= got <= every


def test_fragments_that_share_only_the_anchor_are_left_out():
    u = Units(False, 100, 32, True)
    rng = random.Random(1)
    side = lambda: bytes(rng.choices(b"abcdefgh", k=u.slack))
    anchor, x, y = side()[:32], side(), side()
    frags = [side() + anchor + side() for _ in range(200)] + [x + anchor + y, x + anchor + side(), side() + anchor + y]
    assert np.flatnonzero(may_meet(np.zeros(203, np.uint64), np.full(203, u.slack), frags, u)).tolist() == [200, 201, 202]
