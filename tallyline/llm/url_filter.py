"""URL filters by a temporal list join, in DataFrame operations only.

Dated list entries (a host is added to or removed from a list) become validity intervals; a capture is judged by the
intervals that hold its fetch time. A list entry covers its host and all hosts below it. Each (host, fetch time) is
judged once and the verdict joined back, so a host with very many captures costs one judgement a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.tables import others

#: Intervals that are sent to all tasks at most (about 100 bytes each), and parts that a host's rows are dealt to where there are more.
FEW, SALTS = 100_000, 16


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and final dot; empty where there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.coalesce(F.regexp_replace(F.lower(host), r"\.$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """list, host, since (inclusive), until (exclusive; null: open) from entries list, host, action (add or remove), dated.

    Per list and host the entry of the latest date decides; of several on one date, remove. Entries with a null list,
    host, action or date, or another action, do not count. Neighbouring additions give neighbouring intervals.
    """
    known = entries.where("list IS NOT NULL AND host IS NOT NULL AND dated IS NOT NULL AND action IN ('add', 'remove')")
    daily = known.groupBy("list", F.lower("host").alias("host"), "dated").agg(F.max("action").alias("action"))
    until = F.lead("dated").over(Window.partitionBy("list", "host").orderBy("dated"))
    return daily.withColumn("until", until).where("action = 'add'").select("list", "host", F.col("dated").alias("since"), "until")


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetched_at) with host, blocked (boolean) and lists (names of lists active for it at fetch time, sorted, joined by commas; empty: none).

    Null or hostless URLs and null fetch times are not blocked. Repeated rows are all kept, with equal verdicts. Columns
    of captures named host, blocked or lists (whatever their case) are replaced. Empty captures give an empty result;
    without entries nothing is blocked.

    A host is looked up under itself and all hosts above it, so very many rows ask for a name like ``com``. A short list
    goes to all tasks; of a longer one each task has a part of every host's rows (SALTS).
    """
    own = others(captures, "host", "blocked", "lists")
    rows = captures.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)], host_of(F.col("url").cast("string")).alias("host"), F.col("fetched_at").alias("at"))
    asked = rows.where("host <> '' AND at IS NOT NULL").select(F.col("host").alias("asked"), "at").distinct()
    labels = F.split("asked", r"\.")
    above = asked.withColumn("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    held = intervals(entries).withColumnRenamed("host", "name")
    now = (F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    if held.limit(FEW + 1).count() <= FEW:
        active = above.join(F.broadcast(held), "name").where(now)
    else:
        salted = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        active = above.withColumn("salt", F.pmod(F.xxhash64("asked", "at"), F.lit(SALTS)).cast("int")).join(salted, ["name", "salt"]).where(now)
    verdict = active.groupBy(F.col("asked").alias("host"), "at").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    joined = rows.join(verdict, ["host", "at"], "left")
    return joined.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(own)], "host", F.col("lists").isNotNull().alias("blocked"), F.coalesce("lists", F.lit("")).alias("lists"))
