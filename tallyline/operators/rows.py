"""Rows of worksheets: classes, islands, sections, blocks. Sheets are the partitions of all windows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.texts import COMPATIBLE, DROPPED, clean_text, has_marker

#: What a text that holds a caption of a section has in it, unless it needs NFKC or loses a sign in between.
SECTION_PART = rf"(?iu)сч|hisob|[{DROPPED}]|{COMPATIBLE}"


def is_blank(cells: Column) -> Column:
    """PRD1"""
    return F.forall(cells, lambda c: clean_text(c) == "")


def is_section_header(text: Column) -> Column:
    """PRD4"""
    return F.coalesce(text.rlike(SECTION_PART), F.lit(False)) & has_marker(F.substring(text, 1, 160), "section")


def is_numbering(cells: Column) -> Column:
    """PRD5: at least three cells, all of one or two digits."""
    return numbers(F.transform(cells, clean_text))


def numbers(clean: Column) -> Column:
    """is_numbering of cells that are cleaned already."""
    return F.forall(clean, lambda c: (c == "") | c.rlike(r"^\d{1,2}$")) & (F.size(F.filter(clean, lambda c: c != "")) >= 3)


def trim_rows(rows: DataFrame, sheet: list[str], row: str = "row_idx", cells: str = "cells") -> DataFrame:
    """SRC11: drops blank rows at the end of each sheet."""
    last = F.max(F.when(~is_blank(F.col(cells)), F.col(row))).over(Window.partitionBy(*sheet))
    return rows.withColumn("last_row", last).where(F.col(row) <= F.col("last_row")).drop("last_row")


def islands(rows: DataFrame, sheet: list[str], row: str, gap: int) -> DataFrame:
    """STR3, WIN1: rows at most ``gap`` apart get one island number (from 0)."""
    order = Window.partitionBy(*sheet).orderBy(row)
    far = F.coalesce((F.col(row) - F.lag(row).over(order) > gap).cast("int"), F.lit(0))
    return rows.withColumn("far", far).withColumn("island", F.sum("far").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("far")


def next_bound(df: DataFrame, sheet: list[str], row: str, end: Column) -> DataFrame:
    """WIN2: the row of the next one, or the sheet's end."""
    return df.withColumn("next_row", F.coalesce(F.lead(row).over(Window.partitionBy(*sheet).orderBy(row)), end))


def swept(rows: DataFrame, bounds: DataFrame, key: list[str], at: str, tie: str, name: str) -> DataFrame:
    """JON3: rows with ``name``: of the bounds of their key, the last one at or before them; null before the first.

    bounds: key, at, tie, name. Of bounds at one place the one with the largest tie counts. Rows and bounds pass in one
    order for each key (a sort that spills, read once), so it costs the same whether a key has two bounds or a million,
    and no row meets a bound that is not its own. Rows with a null place come before all bounds.
    """
    first = bounds.select(*key, at, F.col(tie).alias("tie"), F.col(name).alias("bound"), F.lit(0).alias("kind"))
    own = rows.select(*key, at, F.lit(None).cast(first.schema["tie"].dataType).alias("tie"), F.lit(None).cast(first.schema["bound"].dataType).alias("bound"), F.lit(1).alias("kind"), F.struct(*[F.col(c) for c in rows.columns]).alias("row"))
    order = Window.partitionBy(*key).orderBy(F.asc_nulls_first(at), "kind", F.asc_nulls_first("tie")).rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(first.where(F.col(at).isNotNull()), allowMissingColumns=True).withColumn("bound", F.last("bound", True).over(order))
    return both.where("kind = 1").select("row.*", F.col("bound").alias(name))


def layout(total: Column, with_amount: Column) -> Column:
    """STR5"""
    return F.when(with_amount * 16 < total * 10, "block").otherwise("row")


def blocks(rows: DataFrame, sheet: list[str], row: str, starts: Column) -> DataFrame:
    """STR7, WIN5: numbers blocks from 1; rows before the first start belong to none and go."""
    order = Window.partitionBy(*sheet).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("block", F.sum(starts.cast("int")).over(order)).where("block > 0")


def chunks(rows: DataFrame, sheet: list[str], row: str, size: int = 60) -> DataFrame:
    """WIN8: batch number of each row."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*sheet).orderBy(row)) - 1) / size))


def head_tail(rows: DataFrame, sheet: list[str], row: str, head: int, tail: int) -> DataFrame:
    """ORD2, ORD3: the first and the last rows of each sheet."""
    w = Window.partitionBy(*sheet)
    return rows.withColumns({"a": F.row_number().over(w.orderBy(row)), "b": F.row_number().over(w.orderBy(F.desc(row)))}).where((F.col("a") <= head) | (F.col("b") <= tail)).drop("a", "b")
