"""Suffix-array deduplication on bytes: shard arrays by induced sorting, with permuted common prefixes.

``repeats`` brings together the places that can hold equal strings; a shard is a set of such fragments. Its suffix
array comes from induced sorting: suffixes are classified, the leftmost-smaller (LMS) substrings are named and sorted
recursively, down to a text whose names all differ, and everything else is induced from them. A text of bytes is induced
bucket by bucket in numpy, each bucket in a few array operations; a reduced text, whose buckets are small, suffix by suffix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tallyline.llm import textops as T
from tallyline.llm.repeats import Units, removed

#: Mean bucket from which buckets are worked on as arrays.
WIDE = 256


def scatter(sa: np.ndarray, edge: np.ndarray, at: np.ndarray, chars: np.ndarray, step: int) -> None:
    """Appends the suffixes to their buckets, in order; edge holds each bucket's next free place."""
    if len(at) == 0:
        return
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    starts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    n = np.diff(np.concatenate((starts, [len(c)])))
    within = np.arange(len(c)) - np.repeat(starts, n)
    sa[edge[c] + step * within] = at[order]
    edge[c[starts]] += step * n


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All suffixes from LMS suffixes that are sorted (or sorted by their first character, for naming)."""
    n = len(s)
    ends = np.cumsum(counts)
    heads = ends - counts
    sa = np.full(n, -1, np.int64)
    used = np.flatnonzero(counts)
    lms_char = s[lms]
    lms_at = np.searchsorted(lms_char, used), np.searchsorted(lms_char, used, side="right")
    head = heads.copy()
    scatter(sa, head, np.array([n - 1]), s[n - 1 :], 1)  # the end of the text comes before all: its predecessor is the first L suffix
    for c, a, b in zip(used, *lms_at, strict=True):
        done, cur = heads[c], sa[heads[c] : head[c]]
        while len(cur):
            done += len(cur)
            before = cur[cur > 0] - 1
            scatter(sa, head, before[(s[before] == c) & ~small[before]], s[before[(s[before] == c) & ~small[before]]], 1)
            cur = sa[done : head[c]]
        cur = np.concatenate((sa[heads[c] : head[c]], lms[a:b]))
        before = cur[cur > 0] - 1
        before = before[s[before] > c]
        scatter(sa, head, before, s[before], 1)
    tail = ends - 1
    for c in used[::-1]:
        done, cur = ends[c] - 1, sa[tail[c] + 1 : ends[c]][::-1]
        while len(cur):
            done -= len(cur)
            before = cur[cur > 0] - 1
            before = before[(s[before] == c) & small[before]]
            scatter(sa, tail, before, s[before], -1)
            cur = sa[tail[c] + 1 : done + 1][::-1]
        cur = np.concatenate((sa[tail[c] + 1 : ends[c]][::-1], sa[heads[c] : head[c]][::-1]))
        before = cur[cur > 0] - 1
        before = before[s[before] < c]
        scatter(sa, tail, before, s[before], -1)
    return sa


def induce_each(s: np.ndarray, small: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The same, suffix by suffix."""
    n, ends = len(s), np.cumsum(counts)
    # The character before each suffix if that is a large one, or a small one, else -1; the entry behind the last is for a free place (-1).
    before = np.concatenate(([-1], s[:-1], [-1]))
    is_small = np.concatenate(([False], small[:-1], [False]))
    large_before, small_before = np.where(is_small, -1, before).tolist(), np.where(is_small, before, -1).tolist()
    tail, text = (ends - 1).tolist(), s.tolist()
    sa = [-1] * n
    for j in lms[::-1].tolist():
        c = text[j]
        sa[tail[c]] = j
        tail[c] -= 1
    head = (ends - counts).tolist()
    c = text[-1]
    sa[head[c]] = n - 1  # before the end of the text; no LMS suffix stands at the head of a bucket that has a large one
    head[c] += 1
    for j in sa:
        c = large_before[j]
        if c >= 0:
            at = head[c]
            sa[at] = j - 1
            head[c] = at + 1
    tail = (ends - 1).tolist()
    for j in reversed(sa):
        c = small_before[j]
        if c >= 0:
            at = tail[c]
            sa[at] = j - 1
            tail[c] = at - 1
    return np.array(sa, np.int64)


def differ(s: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether s[a:a+size] and s[b:b+size] differ, compared unit by unit, each pair as far as it agrees."""
    out = np.zeros(len(a), bool)
    at = np.arange(len(a))
    for k in range(int(size.max(initial=0))):
        at = at[size[at] > k]
        if len(at) < 16:
            for i in at:
                out[i] = not np.array_equal(s[a[i] + k : a[i] + size[i]], s[b[i] + k : b[i] + size[i]])
            break
        off = s[a[at] + k] != s[b[at] + k]
        out[at[off]] = True
        at = at[~off]
    return out


def suffix_array(s: np.ndarray, sigma: int = 256) -> np.ndarray:
    """Starts of the suffixes of s (integers in 0..sigma-1) in order; a suffix comes before those it begins."""
    s = s.astype(np.int64)
    n = len(s)
    if n < 2:
        return np.arange(n)
    step = np.sign(np.diff(s))
    step = np.concatenate((step, [-1]))  # the last one is larger than the end of the text
    turns = np.flatnonzero(step)
    small = step[turns[np.searchsorted(turns, np.arange(n))]] > 0
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    counts = np.bincount(s, minlength=sigma)
    all_of = induce if n >= WIDE * np.count_nonzero(counts) else induce_each
    if len(lms) > 1:
        first = all_of(s, small, lms[np.argsort(s[lms], kind="stable")], counts)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = first[is_lms[first]]
        stop = np.full(n, n, np.int64)
        stop[lms[:-1]] = lms[1:] + 1
        size = stop[order] - order
        # The last LMS substring ends with the text, which no other one does.
        new = (size[1:] != size[:-1]) | (stop[order][1:] == n) | (stop[order][:-1] == n)
        alike = np.flatnonzero(~new)
        new[alike] = differ(s, order[alike], order[alike + 1], size[alike])
        names = np.zeros(n, np.int64)
        names[order] = np.concatenate(([0], np.cumsum(new)))
        kinds = int(names[order[-1]]) + 1
        lms = lms[suffix_array(names[lms], kinds)] if kinds < len(lms) else order
    return all_of(s, small, lms, counts)


def common_prefixes(buf: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: in text order, how many bytes a suffix shares with the one before it in sa (the first: 0).

    Where both of a suffix's neighbours move on by one byte, so does the prefix: it is one less than that of the suffix
    before. Only the other suffixes are compared, eight bytes at a time; their prefixes add up to n log n at most.
    """
    n = len(buf)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (phi[:-1] >= 0) & (phi[1:] == phi[:-1] + 1)
    # One that follows is only settled by the one before if that one's prefix is not empty.
    follows[1:] &= buf[:-1] == buf[np.maximum(phi[:-1], 0)]
    alone = np.flatnonzero(~follows & (phi >= 0))
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    word = np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + 1].copy().view(np.uint64).ravel()
    room = n - np.maximum(alone, phi[alone])
    got = np.zeros(len(alone), np.int64)
    at = np.arange(len(alone))
    while len(at):
        x = word[np.minimum(alone[at] + got[at], n)] ^ word[np.minimum(phi[alone[at]] + got[at], n)]
        same = np.where(x == 0, 8, 0)
        low = x & (~x + T.U64(1))  # the lowest bit that differs
        some = x != 0
        same[some] = np.log2(low[some].astype(float)).astype(np.int64) >> 3
        got[at] += same
        at = at[(same == 8) & (got[at] < room[at])]
    plcp = np.zeros(n, np.int64)
    plcp[alone] = np.minimum(got, room)
    start = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return np.where(follows, plcp[start] - (np.arange(n) - start), plcp)


def may_meet(key: np.ndarray, left: np.ndarray, frags: list[bytes], u: Units) -> np.ndarray:
    """Which fragments can share a window with another one of their key; the others need no suffix array.

    Fragments of a key can only share windows that lie alike around their anchors, with ``x`` of ``u.slack`` bytes before and the
    others behind. Whichever quarter of the slack x is in, two that share one agree in the bytes that every such window
    has. A fragment that agrees with no other in any of the four stretches shares none.
    """
    buf, start, end = T.join_documents(frags)
    values = T.byte_values(buf)
    at = start + left
    out = np.zeros(len(frags), bool)
    for i in range(4):
        least, most = i * (u.slack + 1) // 4, (i + 1) * (u.slack + 1) // 4 - 1
        a, b = at - least, at + u.gram + u.slack - most
        inside = np.flatnonzero((a >= start) & (b <= end) & (most >= least))
        if len(inside) == 0:
            continue
        k, h = key[inside], T.span_hashes(values, a[inside], b[inside])
        order = np.lexsort((h, k))
        same = (k[order][1:] == k[order][:-1]) & (h[order][1:] == h[order][:-1])
        out[inside[order[1:][same]]] = True
        out[inside[order[:-1][same]]] = True
    return out


def shard(key: np.ndarray, left: np.ndarray, doc: np.ndarray, pos: np.ndarray, frags: list[bytes], u: Units) -> tuple[np.ndarray, np.ndarray]:
    """Documents and starts of the strings of u.length bytes that start earlier elsewhere in the shard."""
    buf, start, end = T.join_documents(frags)
    sa = suffix_array(buf)
    shared = common_prefixes(buf, sa)[sa]  # with the suffix before it in the array
    of = np.minimum(np.searchsorted(end, sa, side="right"), len(end) - 1)
    room = (sa >= start[of]) & (end[of] - sa >= u.length)  # neither separators nor the last bytes of a fragment
    # Runs of suffixes that share u.length bytes, among them only those that have room for as many.
    apart = np.cumsum(shared < u.length)[room]
    sa, of = sa[room], of[room]
    if len(sa) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    run = np.concatenate(([0], np.cumsum(apart[1:] != apart[:-1])))
    d, p = doc[of], pos[of] + sa - start[of]
    order = np.lexsort((p, d))
    new = np.concatenate(([True], (d[order][1:] != d[order][:-1]) | (p[order][1:] != p[order][:-1])))
    rank = np.empty(len(d), np.int64)
    rank[order] = np.cumsum(new)
    least = np.minimum.reduceat(rank, np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))))
    gone = rank > least[run]
    return d[gone], p[gone]


def suffix_dedup(documents: DataFrame, length: int = 100, gram: int = 32) -> DataFrame:
    """Removes every byte covered by a string of ``length`` bytes that also starts earlier (smaller doc_id, or same document, earlier start).

    Texts are UTF-8 bytes; strings lie in one document and are judged on the input. Returns documents'
    columns and n_units (bytes), n_removed, removed_spans (byte ranges, maximal runs), kept (binary).

    Null text: empty. A null doc_id: the row stays whole and matches nothing. A document is a (doc_id, text): rows that repeat
    both are one occurrence, do not remove each other and get one result; one doc_id with several texts is several
    documents, in the order of a digest of their texts. Other columns are kept; those named like a result (whatever their case) are replaced. An
    empty table gives an empty result.
    """
    if not 1 <= gram <= length:
        raise ValueError("gram must be between 1 and length")
    u = Units(False, length, gram, True)
    return removed(documents, u, shard, may_meet)
