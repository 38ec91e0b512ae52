"""N-gram Jaccard join by prefixes, and the components of its links.

A document's shingles are put in one order for all (rare before frequent); two sets with a Jaccard similarity of at
least t share a shingle in prefixes of n - ceil(t n) + 1. A document whose prefix would meet many others takes a
prefix longer by ``need`` - 1 instead. A pair must then share as many as the less
demanding of the two asks for, in the shorter prefixes that their two sizes leave.

Equal sets are one class. Links between classes are found in two steps, so that a group of g near copies costs about
g checks and not g * g: first every member of a shingle's group against the group's most common member (the one
nearest to what the group copies); then, where a group still spans several components, all pairs across components.
Every link is between documents that end up in one component, or is checked.

Before texts are sent to be checked, a pair's sketches are compared: bit b of a sketch is the parity of the shingles
that hash to b, so two sets differ in at least as many shingles as their sketches in bits. A pair whose sketches differ
in more bits than a link allows cannot link; no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm import textops as T
from tallyline.llm.repeats import blocks
from tallyline.llm.tables import keyed, texts, written

#: Shingles whose frequency is known to all tasks at most (9 bytes each), and documents a reference set is sent along with.
FREQUENT, TOGETHER = 1 << 19, 64
#: Estimated candidates from which a prefix asks for one more shared shingle each.
COSTS = (256, 4096, 65536)
PREFIX, MEMBER = 0, 1
#: Bytes of text that a task works on at a time, and shingles that it gathers to count those of several documents.
BLOCK, COUNTED = 1 << 20, 1 << 22
#: Bits of the smallest sketch; larger sets have the power of two at or above their size.
SKETCH = 256


def shingles(raw: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted by (document, hash), their documents, and how many each document has."""
    buf, start, end = T.join_documents(raw)
    buf = buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)
    a, b = T.words_of(buf)
    values = T.span_hashes(T.byte_values(buf), a, b)
    first, last = np.searchsorted(a, start), np.searchsorted(a, end)
    grams = T.gram_hashes(values, size)
    doc = T.in_document(a, b, end)
    ok = doc[: len(grams)] == doc[size - 1 :] if len(grams) else np.zeros(0, bool)
    short = np.flatnonzero((last > first) & (last - first < size))
    g = np.concatenate((grams[ok], T.span_hashes(values, first[short], last[short])))
    d = np.concatenate((doc[: len(grams)][ok], short))
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    if len(g):
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])))
        g, d = g[new], d[new]
    return g, d, np.bincount(d, minlength=len(raw))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def sketches(g: np.ndarray, d: np.ndarray, n: np.ndarray) -> pa.Array:
    """One sketch per document; halves folded by XOR give the sketch of half as many bits."""
    bits = (1 << np.ceil(np.log2(np.maximum(n, SKETCH))).astype(np.int64)) if len(n) else np.zeros(0, np.int64)
    end = np.cumsum(bits // 8)
    data = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    at = (T.mix(g + T.U64(2)) & (bits[d] - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_xor.at(data, (end - bits // 8)[d] + (at >> 3), (1 << (at & 7)).astype(np.uint8))
    offsets = np.concatenate(([0], end)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the shorter one's length."""
    if len(a) < len(b):
        a, b = b, a
    x, size = int.from_bytes(a, "little"), 8 * len(a)
    while size > 8 * len(b):
        size //= 2
        x = (x & ((1 << size) - 1)) ^ (x >> size)
    return (x ^ int.from_bytes(b, "little")).bit_count()


def frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted) and the binary logarithm of their counts.

    Each task gives the shingles that several of its documents have, COUNTED shingles at a time. With t such parts, a passage
    that over sqrt(2 t) documents share is met twice in one, so its shingles come last in the order however few of
    their documents lie side by side, and a passage's holders do not all meet. This only puts shingles in order and estimates costs;
    no link depends on it.
    """

    def several(held):
        token = np.sort(np.concatenate(held))
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
        n = np.diff(start)
        return pa.RecordBatch.from_arrays([pa.array(signed(token[start[:-1][n > 1]])), pa.array(n[n > 1])], names=["token", "n"])

    def run(batches):
        held, total = [], 0
        for _, raw in blocks(batches, ["doc", "text"], BLOCK):
            g, _, _ = shingles(raw, size)
            if len(g):
                held.append(g)
                total += len(g)
            if total >= COUNTED:
                yield several(held)
                held, total = [], 0
        if held:
            yield several(held)

    rows = docs.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 3").orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    token, n = rows["token"].to_numpy().astype(np.int64).view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(token)
    return token[order], np.log2(np.maximum(1, n[order])).astype(np.int8)


def prefixes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows of kind PREFIX (token, doc, n, need, common, k1: place in the order) for tokens that several rows have, and of kind MEMBER (doc, n, k1, k2: the set's hash, sketch).

    Tokens among the frequent ones (k2 is 1) are known to be in several rows. Only the others are dealt out by token and
    counted, so no hot token is gathered in a task.
    """
    held = docs.sparkSession.sparkContext.broadcast(frequent(docs, size))  # at most FREQUENT entries

    def run(batches):
        token, level = held.value
        for ids, raw in blocks(batches, ["doc", "text"], BLOCK):
            keep = [i for i, x in enumerate(ids) if x is not None]
            ids, raw = np.array([ids[i] for i in keep], np.int64), [raw[i] for i in keep]
            if not raw:
                continue
            g, d, n = shingles(raw, size)
            k1, k2 = np.zeros(len(raw), np.uint64), np.zeros(len(raw), np.uint64)
            np.add.at(k1, d, T.mix(g + T.U64(1)))
            np.bitwise_xor.at(k2, d, T.mix(g * T.U64(0xC2B2AE3D27D4EB4F)))
            row = lambda key, kind, doc, n, need, common, a, b, sketch: pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(np.full(len(doc), kind, np.int8)), pa.array(doc), pa.array(n.astype(np.int32)), pa.array(need.astype(np.int32)), pa.array(common.astype(np.int32)), pa.array(signed(a)), pa.array(signed(b)), sketch], names=["token", "kind", "doc", "n", "need", "common", "k1", "k2", "sketch"])
            zero = np.zeros(len(raw), np.int32)
            yield row(T.mix(ids.astype(np.uint64)), MEMBER, ids, n, zero, zero, k1, k2, sketches(g, d, n))
            if len(g) == 0:
                continue
            lev = np.zeros(len(g), np.int8)
            if len(token):
                at = np.minimum(np.searchsorted(token, g), len(token) - 1)
                lev = np.where(token[at] == g, level[at], 0).astype(np.int8)
            order = np.lexsort((g, lev, d))
            g, lev = g[order], lev[order]
            start = np.cumsum(n) - n
            place = np.arange(len(g)) - start[d]
            least = -(-n * percent // 100)  # shingles that a partner must share, at least
            base = n - least + 1
            cost = np.bincount(d, np.where((place < base[d]) & (lev > 0), 2.0**lev, 0), len(raw))
            need = np.minimum(1 + sum((cost > c).astype(int) for c in COSTS), np.maximum(least, 1))
            inside = np.flatnonzero(place < (base + need - 1)[d])
            common = 1000 * np.bincount(d, lev > 0, len(raw)) // np.maximum(n, 1)
            w = d[inside]
            yield row(g[inside], PREFIX, ids[w], n[w], need[w], common[w], place[inside], lev[inside] > 0, pa.nulls(len(w), pa.binary()))

    rows = docs.mapInArrow(run, "token long, kind byte, doc long, n int, need int, common int, k1 long, k2 long, sketch binary")
    told = F.expr(f"kind = {MEMBER} OR k2 = 1")
    # Rows that need no count keep a random key, so that one exchange serves both.
    rows = rows.withColumn("dealt", F.when(told, F.xxhash64("doc", "token")).otherwise(F.col("token"))).repartition("dealt")
    alike = Window.partitionBy("dealt", "token", "kind", "k2")
    return written(rows.withColumn("rows", F.count(F.lit(1)).over(alike)).where(told | (F.col("rows") > 1)).drop("rows", "dealt"))


def dealt(pairs: DataFrame) -> DataFrame:
    """The pairs with a part of x: about TOGETHER pairs each, so that no x fills a task."""
    parts = pairs.join(pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts")), "x").withColumn("part", F.expr("pmod(xxhash64(y), parts)"))
    return written(parts.select("x", "part", "y"))


def possible(sketch: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sketches leave room for a link."""
    of = lambda c: sketch.select(F.col("doc").alias(c), F.col("n").alias(f"{c}n"), F.col("sketch").alias(f"{c}s"))
    parts = dealt(pairs)
    own = parts.select("x", "part").distinct().join(of("x"), "x")
    both = parts.join(own, ["x", "part"]).join(of("y"), "y").select("x", "y", "xn", "yn", "xs", "ys")

    def run(batches):
        for batch in (b.slice(a, 1024) for b in batches for a in range(0, b.num_rows, 1024)):
            x, y, xn, yn, xs, ys = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(x)):
                total = xn[i] + yn[i]
                keep.append(differing(xs[i], ys[i]) <= total - 2 * -(-percent * total // (100 + percent)))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return written(both.mapInArrow(run, "x long, y long"), drop=(parts,))


def verified(docs: DataFrame, sketch: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose whole sets link. x's text goes to all its y, in parts of about TOGETHER."""
    near = possible(sketch, pairs, percent)
    parts = dealt(near)
    asked = written(parts.select(F.col("y").alias("doc"), "x", "part", F.lit(1).alias("role")).union(parts.select(F.col("x").alias("doc"), "x", "part", F.lit(0).alias("role")).distinct()), drop=(parts, near))
    sent = docs.join(asked, "doc").select("x", "part", "role", "doc", "text").repartition("x", "part").sortWithinPartitions("x", "part", "role", "doc")

    def run(batches):
        now, own = None, None
        for x, text, part, role, doc in blocks(batches, ["x", "text", "part", "role", "doc"], BLOCK):
            g, _, n = shingles(text, size)
            sets = np.split(g, np.cumsum(n)[:-1])
            out = []
            for i, key in enumerate(zip(x, part, strict=True)):
                if role[i] == 0:
                    now, own = key, sets[i]
                elif key == now:
                    both = len(np.intersect1d(own, sets[i], assume_unique=True))
                    if both and 100 * both >= percent * (len(own) + len(sets[i]) - both):
                        out.append((x[i], doc[i]))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["x", "y"])

    return written(sent.mapInArrow(run, "x long, y long"), drop=(asked,))


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for all nodes that have a link: minimum of neighbours, then labels of labels, until nothing changes."""
    edges = written(links.select(F.col("x").alias("u"), F.col("y").alias("v")).union(links.select("y", "x")).where("u != v").distinct())
    labels = written(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    old = None
    while True:
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = written(step, drop=(old,) if old is not None else ())
        up = step.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        new = written(step.join(up, "label", "left").select("node", F.least("label", F.coalesce("higher", "label")).alias("label"), (F.least("label", F.coalesce("higher", "label")) != F.col("old")).alias("changed")), drop=(step, labels) if old is None else (step,))
        labels, old = new.select("node", "label"), new
        if new.where("changed").limit(1).count() == 0:
            return written(labels, drop=(new, edges))


def grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc, n_shingles, class_id and component_id (keys of documents) for each document (doc, text)."""
    found = prefixes(docs, size, percent)
    member = found.where(f"kind = {MEMBER}").select("doc", "n", "k1", "k2")
    # Written, so that the join reads plain tables and a class with very many members can be split among tasks.
    classes = written(member.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size"))
    member = written(member.join(classes, ["k1", "k2", "n"], "left").select("doc", "n", F.coalesce("rep", "doc").alias("rep")), drop=(classes,))
    sketch = written(found.where(f"kind = {MEMBER}").select("doc", "n", "sketch").dropDuplicates(["doc"]))
    reps = member.select("doc", "rep").distinct()
    near = found.where(f"kind = {PREFIX}").join(reps, "doc").withColumnRenamed("k1", "place").groupBy("token", "rep").agg(*(F.max(c).alias(c) for c in ("n", "need", "common", "place")))
    near = written(near, drop=(found,))
    alike = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    middle = near.groupBy("token").agg(F.max(F.struct("common", (-F.col("rep")).alias("back"), F.col("n").alias("size"))).alias("m"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("token", (-F.col("m.back")).alias("x"), F.col("m.size").alias("xn"))
    star = written(near.join(middle, "token").where((F.col("rep") != F.col("x")) & alike(F.col("n"), F.col("xn"))).select("x", F.col("rep").alias("y")).distinct())
    links = verified(docs, sketch, star, size, percent)
    component = components(links)
    first = component.withColumnRenamed("node", "rep")

    marked = written(near.join(first, "rep", "left").withColumn("label", F.coalesce("label", "rep")), drop=(near, links))
    mixed = marked.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max(F.struct("c", "label")).alias("m"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("token", F.col("m.label").alias("main"))
    open_ = written(marked.join(mixed, "token"), drop=(marked,))
    one = open_.where("label != main").select("token", *(F.col(c).alias(f"{c}1") for c in ("rep", "n", "need", "label", "place")))
    # For two given sizes the prefixes that matter are shorter than for any partner: n - overlap + need of each.
    overlap = F.ceil(percent * (F.col("n") + F.col("n1")) / (100 + percent))
    must = F.least("need", "need1")
    early = (F.col("place") < F.col("n") - overlap + must) & (F.col("place1") < F.col("n1") - overlap + must)
    across = one.join(open_, "token").where((F.col("label1") != F.col("label")) & ((F.col("label") == F.col("main")) | (F.col("rep1") < F.col("rep"))) & alike(F.col("n"), F.col("n1")) & early)
    tried = star.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    across = (
        across.groupBy(F.least("rep", "rep1").alias("x"), F.greatest("rep", "rep1").alias("y"))
        .agg(F.count(F.lit(1)).alias("shared"), F.max(must).alias("must")).where("shared >= must")
        .select("x", "y").join(tried, ["x", "y"], "left_anti")
    )
    across = written(across, drop=(open_, star))
    more = verified(docs, sketch, across, size, percent)
    label = first.withColumnRenamed("rep", "node")
    of = lambda c: more.select("x", "y").join(label.select(F.col("node").alias(c), F.col("label").alias(f"{c}l")), c, "left")
    joined = of("x").join(label.select(F.col("node").alias("y"), F.col("label").alias("yl")), "y", "left").select(F.coalesce("xl", "x").alias("x"), F.coalesce("yl", "y").alias("y"))
    top = components(joined)
    second = top.select(F.col("node").alias("label"), F.col("label").alias("top"))
    out = (
        member.join(first, "rep", "left").withColumn("label", F.coalesce("label", "rep")).join(second, "label", "left")
        .select("doc", F.col("n").cast("long").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("top", "label").alias("component_id"))
    )
    return written(out, drop=(member, component, top, more, across, sketch))


def jaccard_join(documents: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of documents: doc_id, n_shingles, class_id, component_id.

    Texts are lower-cased (A-Z); words are runs of bytes other than blank, tab, LF, VT, FF, CR; a document's set has its
    distinct shingles of ``size`` words, or its whole sequence as one if it has fewer. Documents link when 100 *
    intersection >= percent * union. class_id: smallest doc_id with an equal set; component_id: smallest doc_id
    reachable by links.

    Null, empty or blank texts have an empty set, link with nothing and are their own component. A null doc_id gets
    nulls. Rows with one doc_id and text are one document and all get its result; one doc_id with several texts is several
    documents, each with a result of its own. Other columns are not read. An empty table gives an empty result.
    """
    docs, names = keyed(documents)
    out = grouped(docs, size, percent)
    results = ("n_shingles", "class_id", "component_id")
    if names is None:
        out = out.select(F.col("doc").alias("doc_id"), *results)
    else:
        for c in ("class_id", "component_id"):
            out = out.join(names.select(F.col("doc").alias(c), F.col("doc_id").alias(f"of_{c}")), c).drop(c).withColumnRenamed(f"of_{c}", c)
        out = out.join(names.select("doc", "doc_id"), "doc").select("doc_id", *results)
    unknown = texts(documents).where("doc_id IS NULL").select("doc_id", *(F.lit(None).cast("long").alias(c) for c in results))
    return out.union(unknown)


def one_of_each(documents: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of documents that are the first of their group of near copies, once each; rows without a doc_id all stay.

    The first is the smallest doc_id, of its several texts the one with the smallest digest. Rows that repeat doc_id and
    text and differ in other columns: the first by these columns' values, nulls first.
    """
    docs, names = keyed(documents)
    stay = written(grouped(docs, size, percent).where("component_id = doc").select("doc").distinct())
    # The columns of documents have names of their own until the end, so that none can clash.
    own = {c.lower(): f"own_{i}" for i, c in enumerate(documents.columns)}
    renamed = documents.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(documents.columns)])
    key, text = F.col(own["doc_id"]).cast("long"), F.coalesce(F.col(own["text"]).cast("string"), F.lit(""))
    rows = renamed.where(key.isNotNull()).withColumn("doc_id", key)
    if names is None:
        rows = rows.join(stay.withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi")
    else:
        rows = rows.withColumn("digest", F.xxhash64(text)).join(stay.join(names, "doc").select("doc_id", "digest"), ["doc_id", "digest"], "left_semi")
    rest = [F.col(own[c]) for c in own if c not in ("doc_id", "text")]
    document = ["doc_id"] if names is None else ["doc_id", "digest"]
    first = Window.partitionBy(*document).orderBy(*(rest or [F.lit(1)]))
    rows = rows.withColumn("place", F.row_number().over(first)).where("place = 1")
    columns = [F.col(f"own_{i}").alias(c) for i, c in enumerate(documents.columns)]
    return rows.select(*columns).union(renamed.where(key.isNull()).select(*columns))
