"""Requests to a model that are sent once: a table of answers beside them, keyed by a digest of what was asked.

Requests with one digest are one. Those that the table already answers are not sent; the others go out in tasks of a few
requests each, and a task's answers are in the table as soon as it ends, whatever becomes of the job. So a task that is
redone sends no more than its own few again, and a second run only what is missing. Failures of the transport are rows
too; they are sent again, up to a bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWERS = "digest string, kind string, stopped string, answer string, error string, attempt int"


def digest_of(kind: str, most: int, body: Column) -> Column:
    """What makes two requests the same: their kind, the bound on the answer and the body."""
    return F.sha2(F.concat_ws("\n", F.lit(kind), F.lit(str(most)), F.coalesce(body, F.lit(""))), 256)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The table of answers; empty before the first."""
    try:
        return spark.read.schema(ANSWERS).parquet(path)
    except AnalysisException:  # there is no folder yet
        return spark.createDataFrame([], ANSWERS)


def settled(answers: DataFrame, tries: int) -> DataFrame:
    """digest, stopped, answer, error: one row for each digest that has an answer, or has failed ``tries`` times (its last error)."""
    said = F.col("error").isNull()
    best = F.max_by(F.struct("stopped", "answer", "error"), F.struct(said, "attempt")).alias("a")
    each = answers.groupBy("digest").agg(best, F.bool_or(said).alias("said"), F.count_if(~said).alias("failed"))
    return each.where(F.col("said") | (F.col("failed") >= tries)).select("digest", "a.*")


def send(requests: DataFrame, ask: Callable[[str, str, int], tuple[str, str]], kind: str, most: int, path: str, tries: int = 3, per_task: int = 4) -> DataFrame:
    """Sends what the table at ``path`` does not answer yet; settled() of the requests' digests.

    requests: digest, body. ask(kind, body, most) gives (why it stopped, answer); an exception is a failed try. path: a
    folder that all machines reach; parts are only ever added to it. At most ``per_task`` requests are sent twice if a
    task is lost, and none that was answered in a task that ended.
    """
    spark = requests.sparkSession
    wanted = requests.groupBy("digest").agg(F.first("body").alias("body"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for digest, body, attempt in zip(f["digest"], f["body"], f["attempt"], strict=True):
                try:
                    out.append((digest, kind, *ask(kind, body, most), None, attempt))
                except Exception as e:  # noqa: BLE001 - becomes the try's error
                    out.append((digest, kind, None, None, f"{type(e).__name__}: {e}", attempt))
            yield pd.DataFrame(out, columns=["digest", "kind", "stopped", "answer", "error", "attempt"], dtype=object)

    for _ in range(tries):
        have = stored(spark, path)
        tried = have.groupBy("digest").agg(F.max("attempt").alias("last"))
        missing = wanted.join(settled(have, tries).select("digest"), "digest", "left_anti").join(tried, "digest", "left")
        missing = missing.select("digest", "body", (F.coalesce("last", F.lit(0)) + 1).alias("attempt"))
        n = missing.count()
        if not n:
            break
        # A task's file is moved in place when the task commits, not when the job does.
        dealt = missing.repartition(-(-n // per_task))
        dealt.mapInPandas(run, ANSWERS).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    return settled(stored(spark, path), tries).join(wanted.select("digest"), "digest", "left_semi")
