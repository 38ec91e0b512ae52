"""Exact repeats of L units (words or bytes) over a whole corpus, without pairs of documents.

A *unit* is a word or a byte. Of every window of L units the k-gram with the smallest hash is its anchor, so two
equal windows have equal anchors at the same place. What an anchor can tell about is its *fragment*: the units of
all windows that it is the anchor of. Three levels settle all windows:

1. In a block of documents (a task's own memory): fragments that are equal settle each other at once; one
   of them represents the others from here on. So however often a passage is copied, at most a few rows of
   an anchor leave a block.
2. By anchor hash, over the corpus: anchors that occur once drop out, equal fragments settle each other.
3. Fragments that share the anchor and differ are compared window by window: together in one group while the
   group is small (the caller's method); through keys of their windows' own content where an anchor has more
   than ``SPREAD`` distinct fragments in a block or ``GROUP`` in the corpus, so that no group is large.

``first_stays`` says which copies go: all but the earliest (byte deduplication) or all (word deduplication).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm import textops as T
from tallyline.llm.tables import give_back, keyed, let_go, others, schema_of, small_batches, written

ANCHOR, HOT, WINDOW, SPAN, FRAGMENT = range(5)
ROW = "key long, kind byte, alike long, doc long, pos int, size int, frag binary"
#: Most distinct fragments of one anchor that a block sends on by the anchor's key, and that one group compares.
SPREAD, GROUP = 16, 4096
#: An anchor's place in its fragment and the fragment's length share a number: place * SIZE + length.
SIZE = 4096
#: Bytes of text of a block, and of the fragments that are settled together (a suffix array takes about 200 times its text).
BLOCK_BYTES, SHARD_BYTES = 2 << 20, 1 << 19


@dataclass(frozen=True)
class Units:
    """What is compared. values: one 64-bit value a unit; first, last: a document's range of units in them."""

    words: bool
    length: int
    gram: int
    first_stays: bool

    @property
    def slack(self) -> int:
        return self.length - self.gram

    def of(self, raw: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        buf, start, end = T.join_documents(raw)
        if not self.words:
            return T.byte_values(buf), start, end, (buf, None, None)
        a, b = T.words_of(buf)
        values = T.span_hashes(T.byte_values(buf), a, b)
        return values, np.searchsorted(a, start), np.searchsorted(a, end), (buf, a, b)


def anchors(values: np.ndarray, first: np.ndarray, last: np.ndarray, u: Units) -> tuple[np.ndarray, ...]:
    """Positions, hashes and documents of all anchors, and the first and last window that each is the anchor of.

    A window's anchor is its gram with the smallest upper half of the hash, the leftmost of several. So every window has
    one anchor, which its content alone places in it.
    """
    empty = np.zeros(0, np.int64)
    sizes = np.maximum(0, last - first - u.length + 1)
    if len(values) < u.length or not sizes.any():
        return empty, empty.astype(np.uint64), empty, empty, empty
    grams = T.gram_hashes(values, u.gram)
    low = T.U64(0xFFFFFFFF)
    ranked = grams & ~low
    ranked |= np.arange(len(grams), dtype=np.uint64)
    ranked = T.sliding(ranked, u.length - u.gram + 1, np.minimum)
    ranked &= low
    at = ranked.astype(np.uint32)
    del ranked
    doc = np.repeat(np.arange(len(first), dtype=np.uint32), sizes)
    starts = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
    pos = at[starts]
    new = np.flatnonzero(np.concatenate(([True], (pos[1:] != pos[:-1]) | (doc[1:] != doc[:-1]))))
    end = np.concatenate((new[1:], [len(pos)])) - 1
    pos, doc, lo, hi = pos[new].astype(np.int64), doc[new].astype(np.int64), starts[new], starts[end]
    return pos, grams[pos], doc, lo, hi


def batch(key, kind, alike, doc, pos, size, frag=None) -> pa.RecordBatch:
    n = len(doc)
    signed = lambda x: pa.array(np.asarray(x).astype(np.uint64).view(np.int64))
    return pa.RecordBatch.from_arrays(
        [signed(key), pa.array(np.full(n, kind, np.int8)), signed(alike), pa.array(np.asarray(doc, np.int64)), pa.array(np.asarray(pos, np.int32)), pa.array(np.asarray(size, np.int32)), pa.array(frag, pa.binary()) if frag is not None else pa.nulls(n, pa.binary())],
        names=["key", "kind", "alike", "doc", "pos", "size", "frag"],
    )


def spans(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of kind SPAN: removed units of a document, merged as far as they are at hand."""
    if len(doc) == 0:
        return
    order = np.argsort(doc, kind="stable")
    doc, lo, hi = doc[order], lo[order], hi[order]
    cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True])))
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        x, y = T.merge_spans(lo[a:b], hi[a:b])
        out.append((np.full(len(x), doc[a]), x, y))
    d, x, y = (np.concatenate(p) for p in zip(*out, strict=True))
    yield batch(T.mix(d.astype(np.uint64)), SPAN, x, d, x, y - x)


def groups(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows in sorted columns, and the end."""
    n = len(columns[0])
    new = np.zeros(n + 1, bool)
    new[0] = new[n] = True
    for c in columns:
        new[1:n] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def repeated(sorted_groups: np.ndarray, doc: np.ndarray, pos: np.ndarray, first_stays: bool) -> np.ndarray:
    """Which members of the groups go; members are sorted by (doc, pos), and equal (doc, pos) are one occurrence."""
    a, n = sorted_groups[:-1], np.diff(sorted_groups)
    head = np.repeat(a, n)
    off = (doc != doc[head]) | (pos != pos[head])
    return off if first_stays else np.repeat(np.add.reduceat(off, a) > 0, n) if len(a) else off


def windows_of(values: np.ndarray, at: np.ndarray, u: Units) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of content for the windows that start at the given units."""
    return tuple(T.span_hashes(values, at, at + u.length, which) for which in (0, 1))


def settle_windows(k1, k2, doc, pos, u: Units) -> tuple[np.ndarray, np.ndarray]:
    """Sorts windows by content; what goes, and one of each content that represents it."""
    order = np.lexsort((pos, doc, k2, k1))
    k1, k2, doc, pos = k1[order], k2[order], doc[order], pos[order]
    runs = groups(k1, k2)
    return order[repeated(runs, doc, pos, u.first_stays)], order[runs[:-1]]


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, one after another, and which range each is of."""
    n = np.maximum(0, hi - lo)
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which], which


def level_one(ids: np.ndarray, raw: list[bytes | None], u: Units) -> Iterator[pa.RecordBatch]:
    values, first, last, _ = u.of(raw)
    pos, key, doc, lo, hi = anchors(values, first, last, u)
    if len(pos) == 0:
        return
    hi = hi + u.length
    alike = T.mix(T.span_hashes(values, lo, hi, 1) + (pos - lo).astype(np.uint64))
    did, at = ids[doc], pos - first[doc]
    order = np.lexsort((at, did, alike, key))
    pos, key, doc, lo, hi, alike, did, at = (x[order] for x in (pos, key, doc, lo, hi, alike, did, at))
    runs = groups(key, alike)
    gone = repeated(runs, did, at, u.first_stays)
    yield from spans(did[gone], (lo - first[doc])[gone], (hi - first[doc])[gone])
    reps = runs[:-1]
    by_key = groups(key[reps])
    many = np.repeat(np.diff(by_key) > SPREAD, np.diff(by_key))
    few = reps[~many]
    yield batch(key[few], ANCHOR, alike[few], did[few], at[few], ((at - (lo - first[doc])) * SIZE + hi - lo)[few])
    if many.any():
        hot = reps[many]
        one = hot[groups(key[hot])[:-1]]
        yield batch(key[one], HOT, np.zeros(len(one)), did[one], at[one], np.zeros(len(one)))
        start, which = ranges(lo[hot], hi[hot] - u.length + 1)
        of = hot[which]
        start, keep = np.unique(start, return_index=True)
        of = of[keep]
        k1, k2 = windows_of(values, start, u)
        wd, wp = did[of], start - first[doc[of]]
        gone, stay = settle_windows(k1, k2, wd, wp, u)
        yield from spans(wd[gone], wp[gone], wp[gone] + u.length)
        yield batch(k1[stay], WINDOW, k2[stay], wd[stay], wp[stay], np.full(len(stay), u.length))


def blocks(batches: Iterator[pa.RecordBatch], columns: list[str], limit: int = BLOCK_BYTES) -> Iterator[list]:
    """Rows by column, gathered until their texts (the second column) have limit bytes."""
    let_go()
    have, size = [[] for _ in columns], 0
    for b in (whole.slice(a, 512) for whole in batches for a in range(0, whole.num_rows, 512)):
        cols = [b.column(b.schema.get_field_index(c)) for c in columns]
        raw = cols[1].cast(pa.large_binary()).to_pylist()
        rest = [c.to_pylist() for c in (cols[0], *cols[2:])]
        for i, t in enumerate(raw):
            have[1].append(t)
            have[0].append(rest[0][i])
            for j in range(1, len(rest)):
                have[j + 1].append(rest[j][i])
            size += len(t or b"")
            if size >= limit:
                yield have
                have, size = [[] for _ in columns], 0
    if have[0]:
        yield have
    have.clear()
    give_back()


def known(ids: list, raw: list) -> tuple[np.ndarray, list]:
    """A null id takes part in no comparison."""
    return np.array([i or 0 for i in ids], np.int64), [t if i is not None else None for i, t in zip(ids, raw, strict=True)]


def mapper(u: Units) -> Callable:
    def run(batches):
        for ids, raw in blocks(batches, ["doc", "text"]):
            yield from level_one(*known(ids, raw), u)

    return run


def fetcher(u: Units) -> Callable:
    """Fragments' texts, or their windows' keys, for the anchors asked of each document."""

    def run(batches):
        for ids, raw, wanted in blocks(batches, ["doc", "text", "wanted"], BLOCK_BYTES // 2):
            values, first, last, (buf, a, b) = u.of(raw)
            doc, key, at, size, apart = (np.array(x) for x in zip(*[(i, w["key"], w["pos"], w["size"], w["apart"]) for i, ws in enumerate(wanted) for w in ws], strict=True))
            ids = np.array(ids, np.int64)
            lo = at - size // SIZE + first[doc]
            hi = np.minimum(lo + size % SIZE, last[doc])
            if (s := np.flatnonzero(apart)).size:
                start, which = ranges(lo[s], hi[s] - u.length + 1)
                start, keep = np.unique(start, return_index=True)
                d = doc[s][which[keep]]
                k1, k2 = windows_of(values, start, u)
                yield batch(k1, WINDOW, k2, ids[d], start - first[d], np.full(len(d), u.length))
            if (s := np.flatnonzero(~apart & (hi > lo))).size:
                x, y = (a[lo[s]], b[hi[s] - 1]) if u.words else (lo[s], hi[s])
                frag = [buf[i:j].tobytes() for i, j in zip(x, y, strict=True)]
                yield batch(key[s].astype(np.int64).view(np.uint64), FRAGMENT, (size // SIZE)[s], ids[doc[s]], lo[s] - first[doc[s]], (hi - lo)[s], frag)

    return run


def settler(u: Units, compare: Callable, may_meet: Callable | None = None) -> Callable:
    """Whole groups of a key, as many as make a shard, are settled together; the input is sorted by key.

    may_meet(key, left, frags, u): which fragments can share a window with another one of their key. Only these are compared,
    those of several pieces of the input together.
    """

    def compared(s: pa.Table):
        key, left = (s[c].to_numpy().astype(np.int64) for c in ("key", "alike"))
        doc, pos = (s[c].to_numpy().astype(np.int64) for c in ("doc", "pos"))
        d, p = compare(key.view(np.uint64), left, doc, pos, s["frag"].to_pylist(), u)
        yield from spans(d, p, p + u.length)

    def settle(t: pa.Table, waiting: list):
        kind = t["kind"].to_numpy()
        for which in (WINDOW, FRAGMENT):
            s = t.filter(pa.array(kind == which))
            if s.num_rows == 0:
                continue
            key, alike = (s[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("key", "alike"))
            if which == WINDOW:
                doc, pos = (s[c].to_numpy().astype(np.int64) for c in ("doc", "pos"))
                gone, _ = settle_windows(key, alike, doc, pos, u)
                yield from spans(doc[gone], pos[gone], pos[gone] + u.length)
            elif may_meet is None:
                yield from compared(s)
            else:
                s = s.filter(pa.array(may_meet(key, alike.astype(np.int64), s["frag"].to_pylist(), u)))
                if waiting and sum(w.nbytes for w in waiting) + s.nbytes > SHARD_BYTES:
                    yield from compared(pa.concat_tables(waiting))
                    waiting.clear()
                if s.num_rows:
                    waiting.append(s)

    def run(batches):
        held, size, waiting = [], 0, []
        for b in batches:
            if b.num_rows == 0:
                continue
            held.append(b)
            size += b.nbytes
            if size < SHARD_BYTES:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key = t["key"].to_numpy()
            cut = np.searchsorted(key, key[-1])  # the last key may go on
            if cut:
                yield from settle(t.slice(0, cut), waiting)
                t = t.slice(cut)
            held, size = t.to_batches(), t.nbytes
        if held:
            yield from settle(pa.Table.from_batches(held).combine_chunks(), waiting)
        if waiting:
            yield from compared(pa.concat_tables(waiting))
        held, waiting = [], []
        give_back()

    return run


def repeated_spans(docs: DataFrame, u: Units, compare: Callable, may_meet: Callable | None = None) -> DataFrame:
    """doc, spans array<struct<lo int, hi int>>: for each document (doc, text) with any, the units that go (spans may overlap)."""
    if 2 * u.length - u.gram >= SIZE:
        raise ValueError(f"a fragment of 2 * length - gram units must have less than {SIZE}")
    by_key = Window.partitionBy("key")
    rows = docs.mapInArrow(mapper(u), ROW).repartition("key").withColumn("n", F.count(F.lit(1)).over(by_key))
    kept = written(rows.where("n > 1 OR kind >= 2").drop("n"))
    place = F.struct("doc", "pos")
    alike = Window.partitionBy("key", "alike")
    told = (
        kept.where(f"kind <= {HOT}").repartition("key")
        .withColumns({"first": F.min(place).over(alike), "last": F.max(place).over(alike)})
        .withColumns({"hot": F.max("kind").over(by_key), "least": F.min("alike").over(by_key), "most": F.max("alike").over(by_key), "reps": F.sum((place == F.col("first")).cast("long")).over(by_key)})
        .where(f"kind = {ANCHOR}")
    )
    goes = (place != F.col("first")) if u.first_stays else (F.col("first") != F.col("last"))
    lo = F.col("pos") - F.floor(F.col("size") / SIZE).cast("int")
    equal = told.where(goes).select(F.col("doc"), lo.alias("lo"), (lo + F.col("size") % SIZE).alias("hi"))
    apart = (F.col("hot") == HOT) | (F.col("reps") > GROUP)
    wanted = (
        told.where((place == F.col("first")) & (apart | (F.col("least") != F.col("most"))))
        .groupBy("doc")
        .agg(F.collect_list(F.struct("key", "pos", "size", apart.alias("apart"))).alias("wanted"))
    )
    fetched = docs.join(wanted, "doc").mapInArrow(fetcher(u), ROW)
    settled = (
        fetched.union(kept.where(f"kind = {WINDOW}"))
        .repartition("key").sortWithinPartitions("key")
        .mapInArrow(settler(u, compare, may_meet), ROW)
    )
    at_once = settled.union(kept.where(f"kind = {SPAN}")).select("doc", F.col("pos").alias("lo"), (F.col("pos") + F.col("size")).alias("hi"))
    return written(at_once.union(equal).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), drop=(kept,))


def removed(documents: DataFrame, u: Units, compare: Callable, may_meet: Callable | None = None) -> DataFrame:
    """documents with n_units, n_removed, removed_spans (merged, in units) and kept (binary)."""
    small_batches(documents.sparkSession)
    docs, names = keyed(documents)
    spans_of = repeated_spans(docs, u, compare, may_meet)
    own = others(documents, "n_units", "n_removed", "removed_spans", "kept")
    rows = documents.select(*[F.col("doc_id").cast("long").alias(c) if c.lower() == "doc_id" else F.col(f"`{c}`") for c in own])
    schema = schema_of(rows, own) + ", n_units long, n_removed long, removed_spans array<struct<lo:int,hi:int>>, kept binary"
    key, text = F.col("doc_id"), F.col("text").cast("string")
    here = rows.select(F.struct(*[f"`{c}`" for c in own]).alias("row"), key.alias("id"), text.alias("body"))
    if names is None:
        joined = here.join(spans_of.select(F.col("doc").alias("id"), "spans"), "id", "left")
    else:
        named = names.join(spans_of, "doc").select(F.col("doc_id").alias("id"), "digest", "spans")
        joined = here.withColumn("digest", F.xxhash64(F.coalesce("body", F.lit("")))).join(named, ["id", "digest"], "left")
    joined = joined.select("row", "body", "spans")
    span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches):
        for b in batches:
            n, gone, left, runs = [], [], [], []
            for t, s in zip(b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                t = t or b""
                buf = np.frombuffer(t, np.uint8)
                x, y = T.words_of(buf) if u.words else (None, None)
                size = len(x) if u.words else len(t)
                lo, hi = T.merge_spans(*(np.minimum(size, np.array([p[k] for p in s or []], np.int64)) for k in ("lo", "hi")))
                lo, hi = lo[hi > lo], hi[hi > lo]
                keep = np.ones(size, bool)
                for p, q in zip(lo, hi, strict=True):
                    keep[p:q] = False
                n.append(size)
                gone.append(int((hi - lo).sum()))
                runs.append([{"lo": int(p), "hi": int(q)} for p, q in zip(lo, hi, strict=True)])
                left.append(b" ".join([t[p:q] for p, q in zip(x[keep].tolist(), y[keep].tolist(), strict=True)]) if u.words else t if len(lo) == 0 else buf[keep].tobytes())
            yield pa.RecordBatch.from_arrays([*b.column(0).flatten(), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, span), pa.array(left, pa.binary())], names=[*own, "n_units", "n_removed", "removed_spans", "kept"])

    return joined.mapInArrow(run, schema)
