"""License scans with MinHash bands over overlapping text windows, in DataFrame operations only.

A template is a short notice, or a window of a whole license text (``standard_texts``). Windows of a template's own
length slide over the words of every text, one word at a time. A window retrieves a template if they agree in a band, that is, if one of BANDS hash orders gives both the same smallest shingle. Such a window must hold that template's
smallest shingle of the band, so bands are only worked out for windows around these (at most BANDS for each template). Retrieved templates are verified by exact shingle containment.

A window with a share j of all shingles in common agrees in some band with probability 1 - (1 - j) ** BANDS: for a
template of which 75% is there, j is at least 0.6, and 8 bands miss less than 0.07% even if only one window is tried.
"""

from __future__ import annotations

from pathlib import Path

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.tables import written

SHINGLE, BANDS = 5, 8
#: Words in a window of a whole license text, and from one window's start to the next one's.
WORDS, STEP = 40, 20
#: Short notices in one sentence.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
)


def windows_of(text: str) -> list[str]:
    """Overlapping windows of WORDS words that cover the text, the last one flush with its end; a shorter text is one window."""
    w = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    last = max(0, len(w) - WORDS)
    return [" ".join(w[i : i + WORDS]) for i in [*range(0, last, STEP), last]]


def standard_texts() -> tuple[tuple[str, str], ...]:
    """The windows of every license text, header and notice in the folder ``licenses``: its file's name with the window's number (from 1), and its words."""
    files = sorted((Path(__file__).parent / "licenses").glob("*.txt"))
    return tuple((f"{f.stem} {i}", w) for f in files for i, w in enumerate(windows_of(f.read_text("utf-8")), 1))


#: The one-sentence notices, and whole standard texts and headers in windows.
TEMPLATES = NOTICES + standard_texts()


def word_list(text: Column) -> Column:
    """Words in lower case: runs of letters and digits."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def shingle_at(words: Column, i: Column) -> Column:
    return F.concat_ws(" ", *[F.get(words, i + j) for j in range(SHINGLE)])


def shingle_list(words: Column) -> Column:
    return F.when(F.size(words) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: shingle_at(words, i))).otherwise(F.array().cast("array<string>"))


def smallest(shingles: Column, band: int) -> Column:
    """The band's smallest shingle, by hash."""
    return F.array_min(F.transform(shingles, lambda s: F.struct(F.xxhash64(s, F.lit(band)).alias("h"), s.alias("s"))))["s"]


def license_scan(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = 75) -> DataFrame:
    """doc_id, license, n_template (shingles of the template), n_found (most of them in one window), for documents with percent * n_template <= 100 * n_found.

    Shingles have five words. templates is a fixed list (it is broadcast); those under five words are not looked for.
    Null, empty and short texts match nothing. Rows of one doc_id are one document: one row for each license, with the
    best window of any. A null doc_id is a document of its own. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    listed = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "t int, license string, notice string").select("t", "license", shingle_list(word_list(F.col("notice"))).alias("all")).where("size(all) > 0")
    listed = written(listed.select("t", "license", F.array_distinct("all").alias("parts"), F.size("all").alias("span"), F.array(*[smallest(F.col("all"), b) for b in range(BANDS)]).alias("keys")))
    hash_of = lambda words: F.xxhash64(*[F.get(words, F.lit(j)) for j in range(SHINGLE)])
    known = listed.select("span", F.transform("keys", lambda k: hash_of(F.split(k, " "))).alias("hashes")).collect()  # the fixed list
    schema = "doc_id long, license string, n_template long, n_found long"
    if not known:
        return spark.createDataFrame([], schema)
    most = max(t.span for t in known)
    # A shingle's hash is compared as a number; equal hashes are compared as text below.
    hashed = sorted({h for t in known for h in t.hashes})
    words = documents.select(F.col("doc_id").cast("long").alias("doc_id"), word_list(F.col("text").cast("string")).alias("w"))
    is_key = lambda i: F.xxhash64(*[F.get(F.col("w"), i + j) for j in range(SHINGLE)]).isin(hashed)
    # explode_outer: no filter on "at" is inferred, which would move below and work the words out anew for every shingle.
    places = F.when(F.size("w") >= SHINGLE, F.filter(F.sequence(F.lit(0), F.size("w") - SHINGLE), is_key))
    hits = words.select("doc_id", "w", F.explode_outer(places).alias("at")).where("at IS NOT NULL")
    low = F.greatest(F.lit(0), F.col("at") - most + 1)
    hits = hits.select("doc_id", shingle_at(F.col("w"), F.col("at")).alias("key"), F.slice("w", low + 1, 2 * most - 1 + SHINGLE - 1).alias("w"), (F.col("at") - low).alias("at"))
    # Each key with the bands that it is the template's smallest shingle of.
    bands = lambda k: F.filter(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.get("keys", b) == k)
    keys = listed.select("t", "span", F.explode(F.transform(F.array_distinct("keys"), lambda k: F.struct(k.alias("key"), bands(k).alias("bands")))).alias("k")).select("t", "span", "k.*")
    near = hits.join(F.broadcast(keys), "key").join(F.broadcast(listed.select("t", "license", "parts")), "t")
    low = F.greatest(F.lit(0), F.col("at") - F.col("span") + 1)
    region = F.slice("w", low + 1, 2 * F.col("span") - 1 + SHINGLE - 1)
    near = near.select("doc_id", "license", "parts", "span", "key", "bands", shingle_list(region).alias("region"), (F.col("at") - low).alias("at"))
    # The number of each shingle of the region in the template, from 1; 0 if it is not there.
    near = near.select("*", F.size("region").alias("size"), F.transform("region", lambda s: F.array_position("parts", s).cast("int")).alias("numbers"))

    def agrees(band: Column) -> Column:
        """Some window around the key has no shingle that comes before it in the band's order: the next such ones leave room for a window."""
        order = lambda s: F.struct(F.xxhash64(s, band), s)
        ahead = F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda i: order(F.get("region", i)) < order(F.col("key")))
        left = F.coalesce(F.array_max(F.filter(ahead, lambda i: i < F.col("at"))), F.lit(-1))
        right = F.coalesce(F.array_min(F.filter(ahead, lambda i: i > F.col("at"))), F.col("size"))
        return right - left > F.least("span", "size")

    counts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("size") - F.col("span") + 1)), lambda i: F.size(F.array_except(F.slice("numbers", i, F.col("span")), F.array(F.lit(0)))))
    # Not a filter, which would move below the columns that it reads and work them out anew.
    found = near.select("doc_id", "license", F.size("parts").alias("n_template"), F.when(F.exists("bands", agrees), F.array_max(counts)).alias("n_found"))
    best = found.groupBy("doc_id", "license").agg(F.max("n_template").cast("long").alias("n_template"), F.max("n_found").cast("long").alias("n_found"))
    return best.where(F.col("n_template") * percent <= 100 * F.col("n_found"))
