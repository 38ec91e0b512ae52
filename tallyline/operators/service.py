"""What a conversion service decides about requests and reports about itself, as Column rules and small aggregates."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.vocabulary import BANKS

#: Accepted names of modes, and what they stand for.
MODE_ALIASES = {
    "ai": "ai",
    "model-ai": "ai",
    "model_ai": "ai",
    "offline": "offline",
    "model-offline": "offline",
    "model_offline": "offline",
    "auto": "auto",
    "model-auto": "auto",
    "model_auto": "auto",
    "rules": "offline",
}
#: Parts of file names that decide the mode, and the size in KiB from which a file is hard.
SIMPLE_NAMES = ("ipotek", "mkb", "xalq", "tenge", "hamkor", "aloqa")
HARD_NAMES = ("dbo", "block", "multi", "complex", "report")
SIMPLE_ENDINGS = (".csv", ".tsv", ".html", ".htm")
HARD_KIB = 256
#: Bytes that a file may have, and the paths whose calls are counted.
MOST_BYTES = 32 * 1024 * 1024
TRACKED = ("/formats", "/convert", "/convert/transactions", "/convert/batch")
INPUT_FORMATS = (".xlsx", ".xlsm", ".xls", ".xls (HTML)", ".htm", ".html", ".csv", ".tsv")


def mode(model: Column, name: Column, engine: Column) -> Column:
    """SVC7: ai, offline or auto by the first of the three that is not empty; null if that one is unknown or all are empty."""
    asked = F.coalesce(*[F.nullif(c, F.lit("")) for c in (model, name, engine)])
    known = F.create_map(*[F.lit(x) for pair in MODE_ALIASES.items() for x in pair])
    return F.try_element_at(known, F.lower(F.trim(asked)))


def auto_mode(file: Column, n_bytes: Column, extractor: Column, by_ending: bool = True) -> Column:
    """SVC8: the mode that auto stands for, by the last part of the path and the bytes of the file. Without an extractor all is offline; by_ending: csv and html always are."""
    name = F.lower(F.regexp_extract(F.coalesce(file, F.lit("")), r"([^/\\]*)$", 1))
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w))
    plain = F.exists(F.array(*map(F.lit, SIMPLE_ENDINGS)), lambda e: F.endswith(name, e)) if by_ending else F.lit(False)
    hard = F.floor(n_bytes / 1024) >= HARD_KIB
    return F.when(~extractor | plain | holds(SIMPLE_NAMES), "offline").when(holds(HARD_NAMES) | hard, "ai").otherwise("offline")


def upload_status(n_bytes: Column, kind: Column, error: Column, n_accounts: Column, passed: Column, strict: Column) -> Column:
    """SVC9: the status of a converted file: 400 empty, 413 too large, 415 of no known kind, 422 unreadable, without an account, or strict and not passed, else 200."""
    return (
        F.when(F.coalesce(n_bytes, F.lit(0)) == 0, 400).when(n_bytes > MOST_BYTES, 413).when(kind.isNull(), 415)
        .when(error.isNotNull() | (F.coalesce(n_accounts, F.lit(0)) == 0) | (strict & ~F.coalesce(passed, F.lit(False))), 422).otherwise(200)
    )


def tracked(calls: DataFrame, path: str, status: str) -> DataFrame:
    """SVC11: calls of counted paths, with ``failed``; refused keys (401) count as neither, a call without a status has failed."""
    code = F.col(status)
    return calls.where(F.col(path).isin(*TRACKED) & F.coalesce(code != 401, F.lit(True))).withColumn("failed", ~F.coalesce(code.between(200, 399), F.lit(False)))


def totals(days: DataFrame) -> DataFrame:
    """AGG9: one row of sums over the days; zeros without any."""
    return days.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("total", "success", "error")])


def metrics(days: DataFrame, today: Column) -> DataFrame:
    """SVC2: one row: figures of today, of all days, and the days as a map."""
    day = F.struct("total", "success", "error")
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("total", "success", "error")])
    all_days = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("day").cast("string").alias("day"), day.alias("figures")))))
    sums = F.struct(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("total", "success", "error")])
    return days.agg(F.coalesce(F.max(F.when(F.col("day") == today, day)), none).alias("today"), sums.alias("totals"), all_days.alias("days"))


def status_text(figures: Column, is_up: Column) -> Column:
    """STM4: the state, and today's figures (a struct of total, success, error; null: not known)."""
    said = F.concat(F.lit("Today - calls: "), figures["total"].cast("string"), F.lit(", success: "), figures["success"].cast("string"), F.lit(", errors: "), figures["error"].cast("string"))
    return F.concat(F.lit("API status: "), F.when(is_up, "UP").otherwise("DOWN"), F.lit("\n"), F.coalesce(said, F.lit("Metrics unavailable.")))


def formats(spark: SparkSession) -> DataFrame:
    """SVC3, ORD7: one row: input formats, modes and known banks by name."""
    texts = lambda x: F.array(*map(F.lit, x))
    return spark.range(1).select(texts(INPUT_FORMATS).alias("input_formats"), texts(("ai", "offline", "auto")).alias("modes"), texts(sorted({b for b, _ in BANKS})).alias("known_banks"))
