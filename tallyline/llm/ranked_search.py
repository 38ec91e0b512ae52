"""Ranked lexical search over postings that are a term-bucketed table, in DataFrame operations only.

A document's terms are sorted and their runs give the occurrences, so postings need no shuffle to be counted. They are
written by term bucket (a hot bucket in several files: the rebalance splits it). Items meet them by term; a match's
integer score depends on term and document alone and is worked out once for each posting. Scored postings then go to
their document, where they meet the items that ask for the term and are summed: no pair of item and document is shuffled
before each task has cut its list to the k best of an item.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.tables import shared_folder, written

#: Maximal runs of ASCII letters, digits and anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of (item, term) that are sent to all tasks; more of them meet the postings by a shuffle.
FEW = 200_000


def terms_of(text: Column) -> Column:
    """All terms of a text, in order, with repeats; null has none. Only A-Z are lower-cased."""
    return F.coalesce(F.regexp_extract_all(F.translate(text.cast("string"), UPPER, LOWER), F.lit(TERM), F.lit(0)), F.array())


def asked_terms(items: DataFrame) -> DataFrame:
    """item_id, term: each term of an item once; rows that repeat an item_id are one item."""
    return items.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct()


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def postings(documents: DataFrame, only: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """term, tf, row (a number for the document), doc_id, n (its terms, with repeats) by bucket of the term, written.

    Besides its terms, each document that has any gives one row with a null term, in bucket -1. only: terms (column term);
    others are left out.
    """
    spark = documents.sparkSession
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), terms_of(F.col("text")).alias("terms"))
    docs = docs.withColumn("n", F.size("terms").cast("long")).where("n > 0")
    # "a a b " -> "a a ", "b ": the runs of equal terms.
    runs = F.regexp_extract_all(F.concat(F.array_join(F.sort_array("terms"), " "), F.lit(" ")), F.lit(r"([^ ]+ )\1*+"), F.lit(0))
    each = docs.select("row", "doc_id", "n", F.explode(F.concat(F.array(F.lit(None).cast("string")), runs)).alias("run"))
    term = F.substring_index("run", " ", 1)
    each = each.withColumn("term", term).withColumn("tf", (F.length("run") / (F.length("term") + 1)).cast("long")).drop("run")
    if only is not None:
        wanted = each.join(_sent(only.select("term").distinct().withColumn("wanted", F.lit(True))), "term", "left")
        each = wanted.where("wanted OR term IS NULL").drop("wanted")
    bucketed = each.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")))
    path = f"{shared_folder(spark)}/tallyline-{uuid.uuid4().hex}"
    bucketed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
    return spark.read.schema(bucketed.schema).parquet(path)


def ranked(index: DataFrame, asked: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents; index: postings(), asked: asked_terms(), written."""
    documents = index.where("bucket = -1").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_terms = documents["n"], documents["l"] or 1
    wanted = asked.select("term").distinct()
    counts = index.where("bucket >= 0").join(_sent(wanted), "term", "semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    known = written(counts.select("term", F.monotonically_increasing_id().alias("number"), weight.cast("long").alias("w")).where("w > 0"))

    # n and N may be large: their product is taken in decimals.
    mean = F.expr(f"50L + (cast(50L * n AS decimal(19, 0)) * cast({n_docs} AS decimal(19, 0))) div cast({n_terms} AS decimal(19, 0))")
    scored = index.where("bucket >= 0").join(_sent(known), "term").withColumn("m", mean)
    points = F.col("w") * F.expr("(1000000000L * tf) div (1000L * tf + 20L * m)")
    scored = scored.select("row", "doc_id", "number", points.alias("points")).where("points > 0").repartition("row")

    items = written(asked.join(known, "term").select("item_id", "number"))
    sums = scored.join(_sent(items), "number").groupBy("item_id", "row", "doc_id").agg(F.sum("points").alias("score"))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    out = sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")


def ranked_search(documents: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): the k documents (all, if fewer) with the highest scores above 0.

    documents: doc_id, text; items: item_id, text; other columns are not read. A term's weight is
    floor(1000 ln((2N + 2) / (2df + 1))) of the N documents that have terms; each of the item's terms, once, adds
    weight * (10^9 tf div (1000 tf + 20 m)), m = 50 + 50 n N div L. Equal scores go by doc_id, a null one last.

    A row is a document: rows that repeat a doc_id, or doc_id and text, are ranked each. Null and empty texts have no
    terms and are not counted. Rows that repeat an item_id are one item with the terms of all; null is an item too. Empty
    tables give an empty result.
    """
    asked = written(asked_terms(items))
    return ranked(postings(documents, only=asked), asked, k)
