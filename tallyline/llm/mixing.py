"""Mixing sources to target weights: Efraimidis-Spirakis sampling with prefix sums, in DataFrame operations only.

Every document has an exponential key divided by its quality weight, drawn from a hash of its id, so better documents
come first more often and reruns agree. A source's budget takes complete epochs first; what is left takes documents in
key order until their prefix sum reaches it, the last one in part. Prefix sums go in two levels: a source is cut in key
ranges of about RANGE documents, ranges are summed, and rows only meet those of their own range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.tables import others, written

BLANKS = r"\x20\x09-\x0D"
RANGE, FEW_SOURCES = 4096, 50_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blank, tab, LF, VT, FF, CR; null: 0."""
    one_each = F.length(F.regexp_replace(text, f"[{BLANKS}]*+[^{BLANKS}]++[{BLANKS}]*+", "x"))
    return F.when(text.rlike(f"[^{BLANKS}]"), one_each).otherwise(0).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[{BLANKS}]*[^{BLANKS}]+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, rows -> with target. Shares by weight of ``share`` times all sizes, none above ``most`` times
    its source: with sources by the level at which they fill up, the level that stands is the largest that its own
    source and all after it can take."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    full = Window.orderBy("fills", F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("fills", F.col("cap") / F.col("weight"))
    s = s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    s = s.withColumn("below", F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.col("below")) / F.col("open"))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("fills"), F.col("level"))).over(everything))
    return s.withColumn("target", F.least("cap", F.coalesce("level", F.lit(0.0)) * F.col("weight")))


def mix(documents: DataFrame, quality: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """documents with size, source_size, target and taken (long: words that the mix takes, repeats counted).

    quality: doc_id, quality (1 good, 0 poor); the largest of several; documents without one, or with a null one, are in
    between (key weights 2, 0.5, 1). Sources by code point, null last, weigh ``weights``, repeating. A document that a
    budget ends in is taken up to that word. most may be 2 at most: no document is taken more often than that.

    Null text: size 0, taken 0. A document with a null doc_id draws by its text. Rows that repeat a doc_id are documents of
    their own that share a draw; equal keys go by doc_id, then size, then a digest. Rows that repeat doc_id, source and text
    are alike: what is taken of them is shared evenly, to whole words. Sources without words have target 0. An empty
    table gives an empty result. Columns of documents named size, source_size, target or taken (whatever their case) are replaced.

    Texts are read once for their sizes; all sorting is done on narrow rows, which meet the documents again by digests.
    """
    own = others(documents, "size", "source_size", "target", "taken")
    key, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    # A hash passes over nulls, so which columns are null is part of the digests.
    nulls = F.when(key.isNull(), 1).otherwise(0) + F.when(F.col("source").isNull(), 2).otherwise(0) + F.when(text.isNull(), 4).otherwise(0)
    digests = [F.xxhash64(nulls, key, "source", text).alias("digest_a"), F.xxhash64(F.lit(1), text, "source", key, nulls).alias("digest_b")]
    draw_of = F.md5(F.concat(F.coalesce(key.cast("string"), text, F.lit("")), F.lit(f":{seed}")))
    draw = F.conv(F.substring(draw_of, 1, 13), 16, 10).cast("long")
    narrow = written(documents.select(key.alias("doc_id"), F.col("source").alias("source"), word_count(text).alias("size"), draw.alias("draw"), *digests))
    same = ("digest_a", "digest_b")
    alike = narrow.groupBy(*same, "doc_id", "source", "size", "draw").agg(F.count(F.lit(1)).alias("copies")).withColumn("all_size", F.col("size") * F.col("copies"))

    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    goals = written(targets(sizes, weights, share, most).select("source", "source_size", "rows", "target", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))).alias("number")))
    goal = F.broadcast(goals) if goals.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES else goals  # a row a source
    grade = quality.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("grade"))

    unit = (F.col("draw") + F.lit(0.5)) / F.lit(float(1 << 52))
    better = F.when(F.col("grade") == 1, 2.0).when(F.col("grade") == 0, 0.5).otherwise(1.0)
    rows = alike.join(grade, "doc_id", "left").withColumn("draw_key", -F.log(unit) / better).drop("draw", "grade")
    rows = rows.join(goal.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    parts = F.ceil(F.col("rows") / RANGE)
    rows = rows.withColumn("part", F.least(parts - 1, F.floor((F.lit(1.0) - F.exp(-F.col("draw_key"))) * parts)))

    sums = rows.groupBy("number", "part").agg(F.sum("all_size").alias("part_size"))
    before = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("number", "part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("number", "part").orderBy("draw_key", "doc_id", "size", *same).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("all_size").over(within), F.lit(0))).join(offsets, ["number", "part"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round("target").cast("long") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("all_size"), rest - F.col("ahead") - F.col("offset")))
    taken = (epochs * F.col("size") + F.floor(part / F.col("copies"))).cast("long")
    results = ("size", "source_size", "target", "taken")
    found = placed.withColumn("taken", taken).select(*same, F.col("doc_id").alias("of_id"), F.col("source").alias("of_source"), *results)
    found = written(found, drop=(narrow, goals))
    # The columns of documents have names of their own until the end, so that none can clash.
    docs = documents.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)], *[d.alias(f"own_{n}") for n, d in zip(same, digests, strict=True)])
    number = {c.lower(): f"own_{i}" for i, c in enumerate(own)}
    alike = [F.col(f"own_{n}") == F.col(n) for n in same]
    alike += [F.col(number["doc_id"]).cast("long").eqNullSafe(F.col("of_id")), F.col(number["source"]).eqNullSafe(F.col("of_source"))]
    return docs.join(found, alike).select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(own)], *results)


def taken_text(mixed: DataFrame) -> DataFrame:
    """One row for each time that a document is taken: whole texts, then the part that a budget ends in."""
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    own = others(mixed, "size", "source_size", "target", "taken")
    renamed = [F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)]
    copies = mixed.select(*renamed, F.col("text").alias("text"), whole.alias("whole"), rest.alias("rest"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("copy"))
    copies = copies.where((F.col("copy") <= F.col("whole")) | ((F.col("copy") == F.col("whole") + 1) & (F.col("rest") > 0)))
    text = F.when(F.col("copy") <= F.col("whole"), F.col("text")).otherwise(first_words(F.col("text"), F.col("rest")))
    return copies.select(*[text.alias(c) if c.lower() == "text" else F.col(f"own_{i}").alias(c) for i, c in enumerate(own)])
