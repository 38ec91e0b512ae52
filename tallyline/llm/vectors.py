"""Vectors in packed blocks, and query blocks against candidate blocks.

A block is one row with the ids and the matrix of a bounded number of vectors of one dimension. Blocks meet in a grid: a
query block has a row of it and a copy in every column, a candidate block a column and a copy in every row. They meet
by an equi-join on dimension, row and column. The grid has about two cells for each core of the cluster, so work spreads
whatever the vectors are like, each block is copied about as often as the root of that, and a task holds two blocks at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.tables import written

BLOCK = "dim int, block long, ids binary, data binary"


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id, embedding (array<double>) of vectors that are not null, empty, or with a null or non-finite component; zero vectors only if zero."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where("vec_id IS NOT NULL AND size(embedding) > 0").where(finite)
    return v if zero else v.where(F.exists("embedding", lambda x: x != 0))


def one_each(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding: of rows that share a vec_id the smallest embedding (compared from the first component on, then by length), written once."""
    return written(vectors.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[int, list] = {}

        def give(dim):
            ids, data = zip(*held.pop(dim), strict=True)
            ids = np.array(ids, np.int64)
            one = int((np.bitwise_xor.reduce(ids * np.int64(2654435761)) ^ len(ids) ^ ids[0] << 20))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([one], pa.int64()), pa.array([ids.tobytes()]), pa.array([np.array(data).tobytes()])], names=["dim", "block", "ids", "data"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                dim = len(v)
                held.setdefault(dim, []).append((i, v.values.to_numpy(zero_copy_only=False)))
                if len(held[dim]) == rows:
                    yield give(dim)
        for dim in list(held):
            yield give(dim)

    with np.errstate(over="ignore"):
        return vectors.mapInArrow(run, BLOCK)


def met(queries: DataFrame, candidates: DataFrame, work: Callable, schema: str, *more: str) -> DataFrame:
    """work(query ids, query matrix, candidate ids, candidate matrix, *more) for every two blocks of one dimension; it gives tuples of columns."""
    side = max(4, ceil(sqrt(2 * queries.sparkSession.sparkContext.defaultParallelism)))
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    of_block = F.expr(f"cast(pmod(xxhash64(block), {side}) as int)")
    q = queries.select("dim", of_block.alias("row"), every.alias("column"), F.col("ids").alias("qids"), F.col("data").alias("qdata"), *more)
    c = candidates.select("dim", every.alias("row"), of_block.alias("column"), "ids", "data")
    pairs = q.join(c, ["dim", "row", "column"])
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                qi, ci = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["ids"], np.int64)
                got = work(qi, np.frombuffer(r["qdata"]).reshape(len(qi), -1), ci, np.frombuffer(r["data"]).reshape(len(ci), -1), *(r[m] for m in more))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=names)

    return pairs.mapInArrow(run, schema)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]
