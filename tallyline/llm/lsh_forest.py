"""Approximate nearest neighbours with a forest of hash prefixes over the whole table.

A tree is one sorted array of 64-bit hash strings (signs of random projections around a mean), cut in parts by range, so
that a prefix, however common, lies in neighbouring parts and no part is large. A query descends each tree to the
strings that share the longest prefix with its own, then ascends in all trees at once, a bit at a time, until ``enough``
strings lie under its prefixes: first strings are counted by how far they agree (in the query's part and the two beside
it), which gives the query's level; then all parts that the prefixes of this level reach are read. What they hold is
compared on the original vectors.

Equal vectors are one entry with its smallest ids, so copies cost nothing. How many strings are enough is fitted to the
data: for SAMPLED queries the nearest are found exactly, and the strings that hold most of them are counted.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.tables import written
from tallyline.llm.vectors import best, met, one_each, packed, usable

BITS = 64
#: Strings of a part, and parts at most (three numbers of each are known to all tasks).
STRINGS, PARTS = 65_536, 1 << 20
#: Vectors that give the mean, and queries that tell how many strings are enough, at most of each dimension.
FITTED, SAMPLED = 4096, 64
ENTRY = "dim int, block long, first binary, ids binary, data binary"
KEEP = np.array([(1 << 64) - (1 << (BITS - n)) if n else 0 for n in range(BITS + 1)], np.uint64)


@lru_cache(maxsize=8)
def projections(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, trees * BITS))


def codes(x: np.ndarray, mean: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """codes[tree, vector], most significant bit first."""
    bits = (x - mean) @ projections(x.shape[1], trees, seed) > 0
    return np.packbits(bits.reshape(len(x), trees, BITS), axis=2).view(">u8")[..., 0].astype(np.uint64).T


def ordered(code: np.ndarray) -> np.ndarray:
    """Signed numbers in the order of the strings."""
    return (code ^ np.uint64(1 << 63)).view(np.int64)


def string(number: np.ndarray) -> np.ndarray:
    return number.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def entries(v: DataFrame, k: int, rows: int) -> DataFrame:
    """Different vectors in blocks of at most ``rows``, each with its k + 1 smallest ids (ids of a block, and where each vector's begin).

    A query has a row for each block that it meets in a tree, so the vectors are dealt out anew, to as many tasks as make
    full blocks: how many blocks there are follows from the vectors, not from the partitions of a shuffle.
    """
    n = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = written(v.withColumn("n", n).where(F.col("n") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    tasks = max(1, -(-few.count() // rows))

    def run(batches):
        held: dict[int, list] = {}

        def give(dim):
            data, ids = zip(*held.pop(dim), strict=True)
            first = np.concatenate(([0], np.cumsum([len(i) for i in ids])))
            flat = np.concatenate([np.array(i, np.int64) for i in ids])
            with np.errstate(over="ignore"):
                one = int(np.bitwise_xor.reduce(flat * np.int64(2654435761) + np.arange(len(flat))) ^ np.int64(len(flat)))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([one], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (first.astype(np.int64), flat, np.array(data)))], names=["dim", "block", "first", "ids", "data"])

        for b in batches:
            for x, i in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                x = x.values.to_numpy(zero_copy_only=False)
                held.setdefault(len(x), []).append((x, i))
                if len(held[len(x)]) == rows:
                    yield give(len(x))
        for dim in list(held):
            yield give(dim)

    return written(few.repartition(tasks).mapInArrow(run, ENTRY), drop=(few,))


def strings_of(blocks: DataFrame, means: dict[int, np.ndarray], trees: int, seed: int) -> DataFrame:
    """part, tree (of its dimension), code, block, place: the sorted arrays of all trees, in parts."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                dim = r["dim"]
                c = ordered(codes(np.frombuffer(r["data"]).reshape(-1, dim), means.get(dim, 0.0), trees, seed))
                n = c.shape[1]
                tree = np.repeat(np.arange(trees) + dim * trees, n)
                yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int64()), pa.array(c.ravel()), pa.array(np.full(len(tree), r["block"])), pa.array(np.tile(np.arange(n, dtype=np.int32), trees))], names=["tree", "code", "block", "place"])

    rows = blocks.select("dim", "block", "data").mapInArrow(run, "tree long, code long, block long, place int")
    n = blocks.agg(F.coalesce(F.sum(F.length("data") / (F.col("dim") * 8)), F.lit(0))).head()[0] * trees
    parts = int(min(PARTS, max(1, -(-n // STRINGS))))
    key = ("tree", "code", "block", "place")
    return written(rows.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id()))


class Map:
    """Where the parts begin and end."""

    def __init__(self, strings: DataFrame):
        ends = strings.groupBy("part").agg(F.min(F.struct("tree", "code")).alias("a"), F.max(F.struct("tree", "code")).alias("b"))
        rows = sorted((r.part, tuple(r.a), tuple(r.b)) for r in ends.collect())  # a row a part, PARTS at most
        self.part, self.low, self.high = ([r[i] for r in rows] for i in range(3))

    def reached(self, tree: int, low: int, high: int) -> range:
        """Places of the parts that hold codes from low to high."""
        return range(bisect_left(self.high, (tree, low)), bisect_right(self.low, (tree, high)))

    def around(self, tree: int, code: int, pick: int) -> range:
        """The query's part (one of them, if equal strings fill several) and the two beside it."""
        own = self.reached(tree, code, code)
        at = own[pick % len(own)] if len(own) else min(own.start, len(self.part) - 1)
        return range(max(0, at - 1), min(len(self.part), at + 2))


def visits(asked: DataFrame, parts: Map, means: dict, trees: int, seed: int, level: bool) -> DataFrame:
    """part, tree, code, query_id, level: which parts a query looks at. asked: vec_id, embedding, and level unless all parts around are meant."""
    held = asked.sparkSession.sparkContext.broadcast(parts)

    def run(frames):
        m = held.value
        for f in frames:
            out = []
            for i, x, n in zip(f["vec_id"], f["embedding"], f["level"], strict=True):
                x = np.array(x, float)[None]
                c = codes(x, means.get(x.shape[1], 0.0), trees, seed)[:, 0]
                low, high = c & KEEP[n], c | ~KEEP[n]
                for t, (code, a, b) in enumerate(zip(*(ordered(y).tolist() for y in (c, low, high)), strict=True)):
                    tree = x.shape[1] * trees + t
                    for p in m.reached(tree, a, b) if level else m.around(tree, code, i):
                        out.append((m.part[p], tree, code, i, n))
            yield pd.DataFrame(out, columns=["part", "tree", "code", "query_id", "level"])

    rows = asked if level else asked.withColumn("level", F.lit(0))
    return rows.select("vec_id", "embedding", "level").mapInPandas(run, "part int, tree long, code long, query_id long, level int")


def merged(strings: DataFrame, asked: DataFrame, work, schema: str) -> DataFrame:
    """work(tree, codes, blocks, places, queries of the tree) for every tree in every part; a part's strings come first, then its queries, some at a time."""
    none = F.lit(None)
    s = strings.select("part", F.lit(0).alias("kind"), "tree", "code", "block", "place", none.cast("long").alias("query_id"), none.cast("int").alias("level"))
    q = asked.select("part", F.lit(1).alias("kind"), "tree", "code", none.cast("long").alias("block"), none.cast("int").alias("place"), "query_id", "level")
    rows = s.union(q).repartition("part").sortWithinPartitions("part", "kind", "tree", "code", "block", "place")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        now, held, table = None, [], None
        for b in batches:
            part = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (b.column(1).to_numpy()[1:] != b.column(1).to_numpy()[:-1]), [True])))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                piece = b.slice(lo, hi - lo)
                if piece.column(1)[0].as_py() == 0:
                    if part[lo] != now:
                        now, held = part[lo], []
                    held.append(piece)
                    table = None
                    continue
                if part[lo] != now:
                    continue
                if table is None:
                    whole = pa.Table.from_batches(held)
                    table = [whole[c].to_numpy() for c in ("tree", "code", "block", "place")]
                tree, code, who, level = (piece.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 6, 7))
                for t in np.unique(tree):
                    a, z = np.searchsorted(table[0], [t, t + 1])
                    if z > a:
                        mine = tree == t
                        for got in work(t, string(table[1][a:z]), table[2][a:z], table[3][a:z], who[mine], string(code[mine]), level[mine]):
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=names)

    return rows.mapInArrow(run, schema)


def counted(t, code, block, place, who, own, level):
    """How many strings agree with a query's in exactly n bits, for each n that occurs."""
    low = own[:, None] & KEEP
    n = np.searchsorted(code, (low | ~KEEP).ravel(), side="right") - np.searchsorted(code, low.ravel())
    n = n.reshape(low.shape)
    n[:, :-1] -= n[:, 1:]
    r, bits = np.nonzero(n)
    yield who[r], bits.astype(np.int32), n[r, bits]


def levels(strings: DataFrame, asked: DataFrame, parts: Map, means: dict, trees: int, seed: int) -> DataFrame:
    """query_id, bits, n: strings of all trees that agree in at least so many bits."""
    seen = merged(strings, visits(asked, parts, means, trees, seed, False), counted, "query_id long, bits int, n long")
    sums = seen.groupBy("query_id", "bits").agg(F.sum("n").alias("n"))
    return sums.withColumn("n", F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bits"))))


def located(t, code, block, place, who, own, level):
    """Places under the queries' prefixes, a row for each query and block."""
    lo = np.searchsorted(code, own & KEEP[level])
    hi = np.searchsorted(code, own | ~KEEP[level], side="right")
    for i, a, z in zip(who, lo, hi, strict=True):
        if z > a:
            order = np.argsort(block[a:z], kind="stable")
            b, p = block[a:z][order], place[a:z][order].astype(np.int32)
            cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True])))
            yield np.full(len(cut) - 1, i), b[cut[:-1]], [p[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]


def enough_of(v: DataFrame, strings: DataFrame, parts: Map, means: dict, k: int, trees: int, seed: int, share: float, block_rows: int) -> int:
    """Strings under which ``share`` of the true neighbours of SAMPLED queries lie."""
    some = one_each(v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLED))

    def exact(qi, q, ci, c):
        out = []
        for i, x in zip(qi, q, strict=True):
            d = np.where(ci == i, np.inf, ((c - x) ** 2).sum(axis=1))
            at = best(-d, ci, k)
            out.append((np.full(len(at), i), ci[at], d[at], [y.tobytes() for y in c[at]]))
        return tuple(np.concatenate([o[n] for o in out]) if n < 3 else sum((o[3] for o in out), []) for n in range(4))

    near = met(packed(some, SAMPLED), packed(v, block_rows), exact, "query_id long, vec_id long, d double, data binary")
    order = Window.partitionBy("query_id").orderBy("d", "vec_id")
    near = near.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("d") < float("inf"))).select("query_id", "data").toPandas()  # SAMPLED * k rows
    own = {r.vec_id: np.array(r.embedding, float) for r in some.collect()}
    held = levels(strings, some, parts, means, trees, seed).toPandas()
    counts = {i: f.sort_values("bits") for i, f in held.groupby("query_id")}
    need = []
    for i, data in zip(near["query_id"], near["data"], strict=True):
        x, y = own[i][None], np.frombuffer(data)[None]
        apart = codes(x, means[x.shape[1]], trees, seed) ^ codes(y, means[x.shape[1]], trees, seed)
        bits = max(BITS - int(a).bit_length() for a in apart[:, 0].tolist())
        f = counts[i]
        need.append(int(f["n"].to_numpy()[np.searchsorted(f["bits"].to_numpy(), bits)]) if bits <= f["bits"].max() else 1)
    return int(np.quantile(need, share)) + 1 if need else 1


def nearest(vectors: DataFrame, is_query, k: int = 10, trees: int = 32, enough: int | None = None, share: float = 0.87, block_rows: int = 4096, seed: int = 1, with_work: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found, by Euclidean distance on the original vectors.

    is_query: condition on vec_id. Candidates: every row whose vec_id is not the query's. A query looks at the vectors under
    the longest prefixes that together hold ``enough`` strings; unset, it is fitted so that they hold ``share`` of the
    neighbours of a sample of SAMPLED vectors. All vectors are indexed. Ties go to the smaller vec_id. Vectors that are
    null, zero, or hold a null or non-finite component take no part; vectors of different lengths do not meet. Rows that
    repeat a vec_id each count as a candidate; a query that repeats its vec_id asks with the smallest of its vectors. Other
    columns are not read. An empty table gives an empty result.

    with_work adds looked: the different vectors that the query was compared with.
    """
    v = usable(vectors, zero=False)
    sample = [np.array(r.embedding, float) for r in v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FITTED).select("embedding").collect()]
    means = {d: np.mean([x for x in sample if len(x) == d], axis=0) for d in {len(x) for x in sample}}
    blocks = entries(v, k, block_rows)
    strings = strings_of(blocks, means, trees, seed)
    parts = Map(strings)
    if enough is None:
        enough = enough_of(v, strings, parts, means, k, trees, seed, share, block_rows)
    asked = one_each(v.where(is_query))
    reach = levels(strings, asked, parts, means, trees, seed).where(F.col("n") >= enough).groupBy(F.col("query_id").alias("vec_id")).agg(F.max("bits").alias("level"))
    told = written(asked.join(reach, "vec_id", "left").withColumn("level", F.coalesce("level", F.lit(0))))
    found = written(merged(strings, visits(told, parts, means, trees, seed, True), located, "query_id long, block long, places binary"), drop=(strings,))

    # A block comes first, then for each query that meets it the query's vector and the places that its trees found.
    none = F.lit(None)
    data = none.cast("binary")
    b = blocks.select("block", none.cast("long").alias("query_id"), F.lit(0).alias("kind"), F.col("data"), "first", "ids")
    q = found.select("block", "query_id").distinct().join(told.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    q = q.select("block", "query_id", F.lit(1).alias("kind"), data, data, data, "embedding")
    p = found.select("block", "query_id", F.lit(2).alias("kind"), F.col("places"), data, data, none.cast("array<double>"))
    rows = b.withColumn("embedding", none.cast("array<double>")).union(q).union(p).repartition("block").sortWithinPartitions("block", "query_id", "kind")

    def compare(batches):
        now, who, x, seen, block = None, None, None, [], None

        def close():
            vectors, first, ids = block
            at = np.unique(np.concatenate(seen))
            d = np.sqrt(((vectors[at] - x) ** 2).sum(axis=1))
            top = best(-d, ids[first[at]], k + 1)
            n = (first[at[top] + 1] - first[at[top]]).astype(np.int64)
            of = np.repeat(top, n)
            one = ids[np.repeat(first[at[top]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            of, one = of[one != who], one[one != who]
            order = np.lexsort((one, d[of]))[:k]
            m = len(order)
            return pa.RecordBatch.from_arrays([pa.array(np.full(m, who)), pa.array(one[order]), pa.array(d[of][order]), pa.array(np.concatenate(([len(at)], np.zeros(m - 1, np.int64))) if m else np.zeros(0, np.int64))], names=["query_id", "vec_id", "score", "looked"])

        for b in batches:
            for r in (row for a in range(0, b.num_rows, 256) for row in b.slice(a, 256).to_pylist()):
                if seen and (r["block"] != now or r["query_id"] != who):
                    yield close()
                    seen = []
                if r["kind"] == 0:
                    now = r["block"]
                    first, ids = np.frombuffer(r["first"], np.int64), np.frombuffer(r["ids"], np.int64)
                    block = np.frombuffer(r["data"]).reshape(len(first) - 1, -1), first, ids
                elif r["kind"] == 1:
                    who, x = r["query_id"], np.array(r["embedding"], float)
                else:
                    seen.append(np.frombuffer(r["data"], np.int32))
        if seen:
            yield close()

    near = rows.mapInArrow(compare, "query_id long, vec_id long, score double, looked long")
    if with_work:
        near = written(near)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    top = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return top.join(near.groupBy("query_id").agg(F.sum("looked").alias("looked")), "query_id") if with_work else top
