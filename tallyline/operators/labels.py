"""Labels through a dictionary.

What a cell says as a label (its role in a header, the kinds of markers that it starts with) depends on its text alone, and
the same few texts come in all statements. So distinct texts are normalised and classed once, in a table, of which only
those that say anything are kept; cells meet it by their text. Cells without a letter are no labels and never leave
their row. What the cells of a row say comes back as one row beside it, in the exchange by sheet that the parse needs.

``told`` works the same out for each cell by Column functions, without a join: for rows that are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline import functions as fn
from tallyline.functions.texts import EXACT, constants, markers, quoted
from tallyline.vocabulary import MARKERS

#: Fixed value: a line that counts turnovers of both sides.
TURNS = "количество оборотов"
#: Entries that are sent to all tasks; a larger dictionary meets the cells by a shuffle.
FEW = 50_000
#: Markers that a label's cell is asked for; captions of sections are looked for in whole rows.
KINDS = tuple(k for k in MARKERS if k not in ("section", "period"))
#: A text of none but ASCII characters that are no letters is no label.
LETTER = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
SAID = "array<struct<i: int, role: string, kinds: array<string>>>"


def kinds_of(normalized: Column) -> Column:
    """The kinds of markers that a normalized label starts with."""
    words = constants([(k, w) for k in KINDS for w in markers(k)] + [("turns", TURNS)], "kind", "word")
    return F.array_distinct(F.transform(F.filter(words, lambda m: F.startswith(normalized, m["word"])), lambda m: m["kind"]))


def skeleton(text: Column) -> Column:
    """The text with all digits alike. No word of the vocabulary has one, so texts of one skeleton say the same."""
    return F.regexp_replace(text, "[1-9]", "0")


def told(clean: Column) -> Column:
    """SAID of a row of cleaned cells: the cells that say anything, in order: i (from 0), role or null, kinds."""
    norm = F.transform(clean, lambda x, i: F.struct(i.alias("i"), F.when(x.rlike(LETTER), fn.normalize_label(x)).alias("norm")))
    norm = F.filter(norm, lambda x: x["norm"] != "")
    classed = F.transform(norm, lambda x: F.struct(x["i"].alias("i"), F.get(F.transform(F.array(fn.fold_homoglyphs(x["norm"])), fn.role_of), F.lit(0)).alias("role"), kinds_of(x["norm"]).alias("kinds")))
    return F.filter(classed, lambda x: x["role"].isNotNull() | (F.size(x["kinds"]) > 0))


def dictionary(texts: DataFrame) -> DataFrame:
    """text (a skeleton), role, kinds of the distinct skeletons that say anything.

    An exact label is an equi-join with the vocabulary (a fixed table of about 200 rows), the first in the vocabulary's order
    counts; only where none is equal its parts are looked for. Null texts and those without a letter say nothing.
    """
    exact = texts.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"({quoted(w)}, {n}, {quoted(r)})" for n, (w, r) in enumerate(EXACT)) + " AS t(folded, n, exact)")
    exact = exact.groupBy("folded").agg(F.min_by("exact", "n").alias("exact"))
    d = texts.where(F.col("text").rlike(LETTER)).select(skeleton(F.col("text")).alias("text")).distinct().withColumn("norm", fn.normalize_label(F.col("text"))).where("norm <> ''")
    d = d.withColumn("folded", fn.fold_homoglyphs(F.col("norm"))).join(F.broadcast(exact), "folded", "left")
    role = F.when(F.length("folded") <= 90, F.coalesce("exact", fn.part_of(F.col("folded"))))
    return d.select("text", role.alias("role"), kinds_of(F.col("norm")).alias("kinds")).where("role IS NOT NULL OR size(kinds) > 0")


def entries(cells: DataFrame, column: str = "clean") -> DataFrame:
    """The dictionary of all cells of a column of arrays."""
    return dictionary(cells.select(F.explode(column).alias("text")))


def _known(words: DataFrame) -> DataFrame:
    """words, sent to all tasks if it has FEW entries at most; not more than that is ever read to see it."""
    held = words.select("text", "role", "kinds").limit(FEW + 1).collect()
    return F.broadcast(words.sparkSession.createDataFrame(held, "text string, role string, kinds array<string>")) if len(held) <= FEW else words


def attached(rows: DataFrame, words: DataFrame, sheet: tuple[str, ...] = ("file", "sheet"), row: str = "row_idx", column: str = "clean") -> DataFrame:
    """rows with ``said`` (SAID; empty: no cell says anything), dealt by sheet and sorted by row. rows: one for each sheet and row.

    words: entries(). A dictionary of at most FEW entries goes to all tasks, so that no cell is shuffled. Cells that say something are gathered by row (no more than a row has) and follow it through the exchange.
    """
    cells = rows.select(*sheet, row, F.posexplode(column).alias("i", "text")).where(F.col("text").rlike(LETTER)).withColumn("text", skeleton(F.col("text")))
    found = cells.join(_known(words), "text").groupBy(*sheet, row).agg(F.sort_array(F.collect_list(F.struct("i", "role", "kinds"))).cast(SAID).alias("said"))
    both = rows.withColumn("said", F.lit(None).cast(SAID)).withColumn("own", F.lit(True)).unionByName(found.withColumn("own", F.lit(False)), allowMissingColumns=True)
    beside = Window.partitionBy(*sheet, row)
    both = both.repartition(*sheet).withColumn("said", F.max("said").over(beside)).where("own").drop("own")
    return both.withColumn("said", F.coalesce("said", F.array().cast(SAID)))


def role_of_texts(texts: DataFrame, words: DataFrame) -> DataFrame:
    """texts (column text) with role: the lookup alone, for a table of single labels."""
    known = _known(words).select(F.col("text").alias("skeleton"), "role")
    return texts.join(known, skeleton(F.col("text")) == F.col("skeleton"), "left").drop("skeleton")
