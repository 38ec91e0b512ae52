"""From paths to results: one call for a conversion. Everything is lazy but the tables kept in between.

convert(...) gives a Conversion: tables of files, accounts and transactions, and payloads made of them. Files are read in
parallel; a file that fails becomes a row with its error and stops no other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators import extraction, service, sinks, statements
from tallyline.sources import files


@dataclass
class Conversion:
    """grid: rows of cells, with errors; files: file, bank, layout, warnings; accounts and transactions of all files.

    listing: file, length of every file that was asked for, also of those without a row (none: the files of the grid count).
    """

    grid: DataFrame
    files: DataFrame
    accounts: DataFrame
    transactions: DataFrame
    listing: DataFrame | None = None
    stored: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Gives back what was persisted for this conversion; its tables are worked out again if they are read after it."""
        for d in self.stored:
            d.unpersist()
        self.stored.clear()

    def payloads(self, extended: bool = False, include_empty: bool = False) -> DataFrame:
        """SNK4 for every file that was read: file, payload."""
        return sinks.payloads(self.files, self.accounts if include_empty else self.accounts.where("transaction_count > 0"), self.transactions, extended)

    def api_payloads(self, extended: bool = False, include_empty: bool = False) -> DataFrame:
        return sinks.api_payloads(self.files, self.accounts, self.transactions, extended, include_empty)

    def flat(self) -> DataFrame:
        return sinks.flat_payloads(self.files, self.accounts, self.transactions)

    def reports(self) -> DataFrame:
        return sinks.reports(self.files, self.accounts)

    def results(self, strict: bool = False) -> DataFrame:
        """SVC6, SVC9: file, status, error, payload: one row for every file, whatever became of it.

        An empty file has 400 and one over the limit 413, whatever is in it; a file of a known kind without any row has no account (422).
        """
        read = self.grid.groupBy("file").agg(F.first("source_format", True).alias("kind"), F.max("error").alias("error"))
        asked = self.listing if self.listing is not None else read.select("file", F.lit(1).cast("long").alias("length"))
        read = asked.join(read.withColumn("any", F.lit(True)), "file", "left")
        read = read.withColumn("kind", F.when(F.col("any").isNull(), "none").otherwise(F.col("kind")))
        sums = self.accounts.groupBy("file").agg(F.count_if(F.col("transaction_count") > 0).alias("n"), F.bool_and("passed").alias("passed"))
        j = read.join(sums, "file", "left").join(self.api_payloads(), "file", "left")
        status = service.upload_status(F.col("length"), F.col("kind"), F.col("error"), F.col("n"), F.col("passed"), F.lit(strict))
        error = F.coalesce("error", F.when(F.col("length") == 0, "empty file").when(F.col("length") > service.MOST_BYTES, "the file is too large"))
        return j.select("file", status.alias("status"), error.alias("error"), F.when(status == 200, F.col("payload")).alias("payload"))


def convert_grid(grid: DataFrame, mode: str = "offline", options: extraction.Options | None = None, name_style: str = "composite", default_currency: str = "UZS", keep: Callable = lambda d: d, listing: DataFrame | None = None) -> Conversion:
    """The same for rows of cells (``sources.files.read_statements``). mode: offline (parsed), ai (by the model, parsed ones where these differ in a file of several accounts) or auto (by file: its name, and its length in ``listing``; without a listing, the bytes of its cells)."""
    good = grid.where("error IS NULL") if "error" in grid.columns else grid
    parsed = statements.statements(good, name_style, default_currency, keep)
    if mode == "offline" or options is None:
        return Conversion(grid, *parsed, listing)
    asked = good
    if mode == "auto":
        sizes = listing.select("file", F.col("length").alias("n")) if listing is not None else good.groupBy("file").agg(F.sum(F.octet_length(F.array_join("cells", ";"))).alias("n"))
        hard = sizes.where(service.auto_mode(F.col("file"), F.col("n"), F.lit(True)) == "ai")
        asked = good.join(hard.select("file"), "file", "left_semi")
    errors, accounts, transactions = extraction.extracted(asked, options, keep)
    accounts, transactions = keep(accounts), keep(transactions)
    files_, p_accounts, p_transactions = parsed
    checked = extraction.compared(accounts, p_accounts.join(accounts.select("file").distinct(), "file", "left_semi"))
    said = errors.groupBy("file").agg(F.sort_array(F.collect_set("error")).alias("said"))
    none = F.array().cast("array<string>")
    files_ = files_.join(said, "file", "left")
    if options.verify:
        files_ = files_.join(extraction.warnings(checked).withColumnRenamed("warnings", "differs"), "file", "left").withColumn("said", F.concat(F.coalesce("said", none), F.coalesce("differs", none))).drop("differs")
    files_ = files_.withColumn("warnings", F.concat("warnings", F.coalesce("said", none))).drop("said")
    mine = accounts.select("file").distinct()
    rest = lambda d: d.join(mine, "file", "left_anti")
    a, t = extraction.chosen((accounts, transactions), (p_accounts.join(mine, "file", "left_semi"), p_transactions.join(mine, "file", "left_semi")))
    return Conversion(grid, files_, a.unionByName(rest(p_accounts), allowMissingColumns=True), t.unionByName(rest(p_transactions), allowMissingColumns=True), listing)


def convert(spark: SparkSession, paths: str | list[str], mode: str = "offline", options: extraction.Options | None = None, name_style: str = "composite", default_currency: str = "UZS", keep: Callable | None = None) -> Conversion:
    """SVC4: the statements under ``paths``. keep stores a table between its readers; unset: a checkpoint if the session has a folder for them, else persist (see ``Conversion.release``)."""
    stored: list[DataFrame] = []

    def persisted(d: DataFrame) -> DataFrame:
        stored.append(d.persist())
        return stored[-1]

    if keep is None:
        keep = (lambda d: d.checkpoint()) if spark.sparkContext.getCheckpointDir() else persisted
    made = convert_grid(keep(files.read_statements(spark, paths)), mode, options, name_style, default_currency, keep, files.listing(spark, paths))
    made.stored = stored
    return made


def transactions(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """SVC5: flat transactions of all files, always parsed."""
    return convert(spark, paths, "offline", **options).flat()
