"""Exact top-k search by a three-phase uniform threshold.

The lists of a query are its partial scores on segments of the dimensions, in each block of candidates; a score is the
sum of its entries.
1. Gather: a block works out the lists of the first half of the dimensions, and whole scores only of the candidates that
   are best by these. The k-th best of them is a cutoff that the final k-th score cannot be below; the largest counts.
2. Broadcast: the cutoff goes back to all blocks. What the lists that are not read yet can add to an entry is at most the
   product of the norms of both vectors' parts. An entry is kept while what it has and what it can still get reach the
   cutoff, list by list; the kept entries are sufficient.
3. Resolve: entries that are kept to the end have been read in all lists, so their scores are exact. Those that reach
   the cutoff, and at most k of a block, compete.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.vectors import best, met, one_each, packed, usable

#: Lists of the second half of the dimensions, and whole scores that a block gathers for each one of k.
SEGMENTS, SEEDS = 4, 4


def integers(x: np.ndarray, other: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of both. As doubles while these hold all sums exactly, else as 64-bit integers."""
    a, b = np.floor(scale * x), np.floor(scale * other)
    top = max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0)) * a.shape[1]
    if top >= 2.0**63:
        raise ValueError("components are too large for 64-bit scores")
    return (a, b) if top < 2.0**53 else (a.astype(np.int64), b.astype(np.int64))


def half_and_rest(dim: int) -> tuple[slice, list[slice]]:
    cut = np.linspace((dim + 1) // 2, dim, SEGMENTS + 1).astype(int)
    return slice(0, cut[0]), [slice(i, j) for i, j in zip(cut[:-1], cut[1:], strict=True) if j > i]


def whole(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray, part: slice) -> np.ndarray:
    """Partial scores on a segment of the entries (r, c), a bounded number at a time."""
    out = np.empty(len(r), a.dtype)
    for i in range(0, len(r), 65536):
        out[i : i + 65536] = np.einsum("ij,ij->i", a[r[i : i + 65536], part], b[c[i : i + 65536], part])
    return out


def sufficient(a: np.ndarray, b: np.ndarray, own: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries (query, candidate, score) of at least the query's cutoff, and how many entries of each query were read in all lists. own: pairs to leave out."""
    first, rest = half_and_rest(a.shape[1])
    norm = lambda x, parts: np.sqrt(sum((x[:, p].astype(float) ** 2).sum(axis=1) for p in parts))
    have = a[:, first] @ b[:, first].T
    reach = np.outer(norm(a, rest), norm(b, rest)) * (1 + 1e-9) + 1e-3
    r, c = np.nonzero((have + reach >= least[:, None]) & ~own)
    score = have[r, c]
    for i, part in enumerate(rest):
        score = score + whole(a, b, r, c, part)
        after = rest[i + 1 :]
        if after:
            keep = score + norm(a, after)[r] * norm(b, after)[c] * (1 + 1e-9) + 1e-3 >= least[r]
            r, c, score = r[keep], c[keep], score[keep]
    keep = score >= least[r]
    return r[keep], c[keep], score[keep], np.bincount(r, minlength=len(a))


def exact_topk(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, query_rows: int = 512, block_rows: int = 4096, with_work: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of floor(scale * x) for each query.

    is_query: condition on vec_id. Candidates: every row whose vec_id is not the query's. Ties go to the smaller vec_id;
    fewer than k rows if there are fewer candidates. Vectors that are null or hold a null or non-finite component take no
    part; vectors of different lengths do not meet. Rows with the same vec_id and vector each count as a
    candidate; a query that repeats its vec_id asks with the smallest of its vectors. Other columns are not read. Components
    so large that a score could exceed 64 bits are an error. An empty table gives an empty result.

    with_work adds resolved: how many of the query's scores were read to their end in the last phase.
    """
    v = usable(vectors, zero=True)
    candidates = packed(v, block_rows)
    asked = one_each(v.where(is_query))
    queries = packed(asked, query_rows)

    def gather(qi, q, ci, c):
        a, b = integers(q, c, scale)
        own = qi[:, None] == ci[None, :]
        first, rest = half_and_rest(a.shape[1])
        have = np.where(own, -np.inf, (a[:, first] @ b[:, first].T).astype(float))
        n = min(SEEDS * k, len(ci))
        r, at = np.repeat(np.arange(len(qi)), n), np.argpartition(have, len(ci) - n, axis=1)[:, len(ci) - n :].ravel()
        score = have[r, at]
        for part in rest:
            score = score + whole(a, b, r, at, part)
        score = score.reshape(len(qi), n)
        full = (score > -np.inf).sum(axis=1) >= k
        kth = np.partition(score, -k, axis=1)[:, -k] if n >= k else np.zeros(len(qi))
        return qi[full], kth[full]

    cutoff = met(queries, candidates, gather, "query_id long, least double").groupBy("query_id").agg(F.max("least").alias("least"))
    named = asked.join(cutoff, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", F.concat(F.array(F.coalesce("least", F.lit(float("-inf")))), "embedding").alias("embedding"))
    told = packed(named, query_rows).withColumn("dim", F.col("dim") - 1)

    def resolve(qi, q, ci, c):
        least = q[:, 0]
        a, b = integers(q[:, 1:], c, scale)
        r, at, score, read = sufficient(a, b, qi[:, None] == ci[None, :], least)
        edge = np.searchsorted(r, np.arange(len(qi) + 1))
        out = [(np.full(len(x), qi[i]), at[lo + x], score[lo + x], np.concatenate(([read[i]], np.zeros(len(x) - 1, np.int64)))) for i, (lo, hi) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if hi > lo and len(x := best(score[lo:hi], ci[at[lo:hi]], k))]
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none, none
        i, at, score, read = (np.concatenate(x) for x in zip(*out, strict=True))
        return i, ci[at], score.astype(np.int64), read

    found = met(told, candidates, resolve, "query_id long, vec_id long, score long, read long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if not with_work:
        return top
    return top.join(found.groupBy("query_id").agg(F.sum("read").alias("resolved")), "query_id", "left")
