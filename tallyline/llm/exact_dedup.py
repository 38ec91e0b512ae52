"""Exact dedup by a Golomb-coded exchange of fingerprints.

Documents are kept in place once, in a table bucketed by sender (a block of at most 2**20 rows of one partition). Each
sender sends its sorted, distinct fingerprints to the owners of their ranges, as Golomb-coded gaps (a divisor that is a
power of two). An owner merges the lists of its range and answers each with a bitmap of those it has seen more than once.
A sender turns its answers into one bitmap over its rows, which meets its bucket without moving a text. Only the texts of
suspects are shuffled: they are grouped by their bytes, equal ones of a task before the shuffle.

What a task holds is bounded: a sender's fingerprints (8 MB) or an owner's range, of which a fingerprint comes at most
once from each sender, so that a text with any number of copies weighs no more than one of each sender.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.tables import others, shared_folder, written

#: Bits of a row's number within its sender.
BLOCK = 20
#: Rows that are coded at once; a multiple of 8, so that pieces end at whole bytes.
_PIECE = 1 << 16
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def golomb(gaps: np.ndarray, k: int) -> tuple[bytes, bytes]:
    """Quotients by 2**k in unary (ones, then a zero) and remainders in k bits, of uint64 gaps."""
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    low = []
    for a in range(0, len(gaps) if k else 0, _PIECE):
        eight = gaps[a : a + _PIECE].astype(">u8").view(np.uint8).reshape(-1, 8)
        low.append(np.packbits(np.unpackbits(eight, axis=1)[:, 64 - k :]).tobytes())
    return np.packbits(unary).tobytes(), b"".join(low)


def golomb_decoded(high: bytes, low: bytes, n: int, k: int) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8)) == 0)[:n]
    gaps = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1) << np.uint64(k)
    packed = np.frombuffer(low, np.uint8)
    for a in range(0, n if k else 0, _PIECE):
        m = min(_PIECE, n - a)
        bits = np.zeros((m, 64), np.uint8)
        bits[:, 64 - k :] = np.unpackbits(packed[a * k // 8 :], count=m * k).reshape(m, k)
        gaps[a : a + m] |= np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return gaps


def _lists(prints: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fingerprints in order, the owners they go to, and where each owner's begin (with the end)."""
    distinct = np.unique(prints)
    owners, at = np.unique(distinct >> np.uint64(shift), return_index=True)
    return distinct, owners.astype(np.int64), np.append(at, len(distinct))


def _send(shift: int) -> Callable:
    def send(block: pa.Table) -> pa.Table:
        sender = block["sender"][0].as_py()
        distinct, owners, at = _lists(block["print"].to_numpy().astype(np.uint64), shift)
        out: dict[str, list] = {c: [] for c in ("sender", "owner", "n", "k", "high", "low")}
        for owner, a, b in zip(owners.tolist(), at[:-1], at[1:], strict=True):
            gaps = np.diff(distinct[a:b], prepend=np.uint64(owner << shift))
            k = max(0, int(np.log2(max(1.0, 0.69 * (1 << shift) / len(gaps)))))
            for name, value in zip(out, (sender, owner, len(gaps), k, *golomb(gaps, k)), strict=True):
                out[name].append(value)
        return pa.table(out, schema=pa.schema([("sender", pa.int64()), ("owner", pa.int64()), ("n", pa.int32()), ("k", pa.int32()), ("high", pa.binary()), ("low", pa.binary())]))

    return send


def _answer(shift: int) -> Callable:
    def answer(sent: pa.Table) -> pa.Table:
        owner = sent["owner"][0].as_py()
        parts = zip(*(sent[c].to_pylist() for c in ("high", "low", "n", "k")), strict=True)
        lists = [np.cumsum(golomb_decoded(*x)) + np.uint64(owner << shift) for x in parts]
        values, times = np.unique(np.concatenate(lists), return_counts=True)
        again = times > 1
        marks = [np.packbits(again[np.searchsorted(values, x)]).tobytes() for x in lists]
        return pa.table({"sender": sent["sender"], "owner": sent["owner"], "marks": pa.array(marks, pa.binary())})

    return answer


def _mark(shift: int) -> Callable:
    def mark(block: pa.Table, answers: pa.Table) -> pa.Table:
        prints = block["print"].to_numpy().astype(np.uint64)
        distinct, owners, at = _lists(prints, shift)
        said = dict(zip(answers["owner"].to_pylist(), answers["marks"].to_pylist(), strict=True))
        again = np.zeros(len(distinct), bool)
        for owner, a, b in zip(owners.tolist(), at[:-1], at[1:], strict=True):
            again[a:b] = np.unpackbits(np.frombuffer(said[owner], np.uint8), count=b - a)
        place, times = np.unique(prints, return_inverse=True, return_counts=True)[1:]
        suspect = (again | (times > 1))[place]
        bits = np.zeros(1 << BLOCK, np.uint8)
        bits[block["row"].to_numpy() & ((1 << BLOCK) - 1)] = suspect
        words = np.packbits(bits[: int(np.flatnonzero(bits).max(initial=-1)) // 64 * 64 + 64], bitorder="little").view("<i8")
        return pa.table({"sender": pa.array([block["sender"][0].as_py()], pa.int64()), "words": pa.array([words.tolist()], pa.list_(pa.int64()))})

    return mark


def _in_buckets(rows: DataFrame) -> DataFrame:
    """rows, written once where every sender's rows are one bucket; nothing is shuffled, as a task's rows have few senders."""
    spark = rows.sparkSession
    name = f"tallyline_{uuid.uuid4().hex}"
    rows.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "sender").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def exact_dedup(documents: DataFrame, fingerprint: Callable[[Column], Column] = F.xxhash64, spare_bits: int = 20, owner_rows: int = 1 << 22) -> DataFrame:
    """documents, every row, with keep_id, group_size (long), kept and text_sha256: which row of equal texts stays.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest doc_id stays;
    null is the smallest, so keep_id is null only where all are. Of rows that repeat both text and doc_id, one stays, by
    its place. An empty table gives an empty result. Columns named like a result, in whatever case, are replaced.

    fingerprint: text -> 64-bit Column, any function; a poor one costs work, not results. spare_bits: fingerprints are
    exchanged in the bits that number the rows and these, so about rows / 2**spare_bits rows are suspects without a
    copy. owner_rows: distinct fingerprints that an owner takes, about.
    """
    own = others(documents, *RESULTS)
    name = {c.lower(): f"own_{i}" for i, c in enumerate(own)}
    key, content = F.col(name["doc_id"]).cast("long"), F.coalesce(F.col(name["text"]).cast("string"), F.lit(""))
    rows = documents.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)])
    rows = rows.withColumns({"sender": F.shiftright("row", BLOCK), "whole": fingerprint(content), "text_sha256": F.sha2(content, 256)})
    held = _in_buckets(rows)

    many = held.count().bit_length()
    width = min(60, many + spare_bits)
    shift = width - min(width, max(5, many - owner_rows.bit_length() + 1))
    narrow = held.select("sender", "row", F.shiftrightunsigned("whole", 64 - width).alias("print"))
    lists = narrow.select("sender", "print").groupBy("sender").applyInArrow(_send(shift), "sender long, owner long, n int, k int, high binary, low binary")
    answers = lists.groupBy("owner").applyInArrow(_answer(shift), "sender long, owner long, marks binary")
    bitmaps = written(narrow.groupBy("sender").cogroup(answers.groupBy("sender")).applyInArrow(_mark(shift), "sender long, words array<long>"))

    place = F.col("row").bitwiseAND((1 << BLOCK) - 1)
    word = F.try_element_at("words", F.shiftright(place, 6).cast("int") + 1)
    suspect = F.coalesce(F.bit_get(word, place.bitwiseAND(63).cast("int")), F.lit(0)) == 1
    flagged = held.join(bitmaps.hint("shuffle_hash"), "sender").withColumn("suspect", suspect).drop("words")
    suspects = flagged.where("suspect").withColumns({"key": key, "content": content})

    best = F.max(F.struct("key", "row")).alias("best")
    equal = suspects.groupBy("whole", "content").agg(best, F.count(F.lit(1)).alias("group_size"))
    classes = written(equal.groupBy("whole").agg(F.count(F.lit(1)).alias("texts"), F.max("best").alias("best"), F.max("group_size").alias("group_size")))
    found = [suspects.join(classes.where("texts = 1").drop("texts"), "whole")]
    mixed = classes.where("texts > 1").select("whole")
    if mixed.limit(1).count():  # different texts with one fingerprint: their rows meet by the texts themselves
        of_mixed = suspects.join(mixed, "whole")
        found.append(of_mixed.join(of_mixed.groupBy("whole", "content").agg(best, F.count(F.lit(1)).alias("group_size")), ["whole", "content"]))

    columns = [F.col(f"own_{i}").alias(c) for i, c in enumerate(own)]
    alone = flagged.where("NOT suspect").select(*columns, key.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    for part in found:
        kept = (F.col("row") == F.col("best.row")).alias("kept")
        alone = alone.union(part.select(*columns, F.col("best.key").alias("keep_id"), "group_size", kept, "text_sha256"))
    return alone
