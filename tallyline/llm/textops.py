"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on one flat byte buffer that holds many documents back to back, so the cost per byte is a
few numpy passes and no Python object is made per word. Hashes are fixed functions of content: they are equal
in every task, run and cluster.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_TOP = U64(0xFFFFFFFFFFFFFFFF)
_CHUNK, _STEP = 1 << 20, 1 << 17


def _byte_values(seed: int) -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * U64(0xD1B54A32D192ED03) + U64(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand by steps: a worker holds hardly more than it has needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.forget()

    def forget(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = -(-n // _STEP) * _STEP
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_POWERS = {0: Powers(_BASE), 1: Powers(0xC2B2AE3D27D4EB4F | 1)}


def forget_powers() -> None:
    """At the end of a task: they are made anew in milliseconds and would fill an idle worker."""
    for p in _POWERS.values():
        p.forget()


_BYTES = {0: _byte_values(0x1234567), 1: _byte_values(0x7654321)}


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit content hash of values[start:end] for each span; spans of other lengths differ as well."""
    n = len(values)
    up, down = _POWERS[which].get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * U64(0xA24BAED4963EE407))


def byte_values(buf: np.ndarray, which: int = 0) -> np.ndarray:
    return _BYTES[which][buf]


def gram_hashes(values: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hashes of all values[i:i+k]; len(values) - k + 1 of them."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, _CHUNK):
        b = min(n, a + _CHUNK)
        part = values[a : b + k - 1]
        up, down = _POWERS[which].get(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        out[a:b] = mix((total[k:] - total[:-k]) * down[: b - a] + U64(k * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
    return out


def sliding(a: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over a[i:i+w], by doubling."""
    have, out = 1, a
    while have < w:
        step = min(have, w - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def words_of(buf: np.ndarray, doc_of_byte_ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes other than blank, tab, LF, VT, FF, CR.

    Documents in the buffer must be separated by at least one such byte.
    """
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def join_documents(texts: list[bytes | None], sep: bytes = b"\n") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with a separator after each text; the starts and ends of the texts in it."""
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    buf = np.frombuffer(sep.join([t or b"" for t in texts]) + sep, np.uint8)
    ends = np.cumsum(sizes + len(sep)) - len(sep)
    return buf, ends - sizes, ends


def in_document(starts: np.ndarray, ends: np.ndarray, doc_ends: np.ndarray) -> np.ndarray:
    """Index of the document that each word (by its start) is in."""
    return np.searchsorted(doc_ends, starts, side="right")


def merge_spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, disjoint and non-adjacent spans with the same union."""
    if len(lo) == 0:
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > top[:-1]))
    return lo[new], top[np.concatenate((new[1:], [True]))]
