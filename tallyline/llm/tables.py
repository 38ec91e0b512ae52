"""Tables written between jobs, and the few Spark helpers the operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import textops

#: Bytes of an Arrow batch that a Python worker is sent; Spark's own default lets 10,000 whole texts wait in the executor and again in the worker.
BATCH_BYTES, SPARKS_OWN = 4 << 20, 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets spark.sql.execution.arrow.maxBytesPerBatch to BATCH_BYTES in the session, unless the session has chosen a limit of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) == f"{SPARKS_OWN}b":
        spark.conf.set(name, BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset (tests)."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def written(df: DataFrame, drop: tuple[DataFrame, ...] = ()) -> DataFrame:
    """df, computed once, written to the shared folder and read again; then the written tables in ``drop`` are deleted.

    Cuts the lineage: a lost executor costs a re-read of these files, not a recomputation. Only drop what no other plan
    reads. What the job shuffled is no longer needed either: a collection on the driver lets Spark clean it up. The files
    of a table that an operator's result reads live as long as the shared folder does.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/tallyline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in drop:
        place = spark._jvm.org.apache.hadoop.fs.Path(old.written_to)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if drop:
        spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


#: What this Python worker holds between tasks: name -> (version, value).
_HELD: dict[str, tuple] = {}


def give_back() -> None:
    """Returns free memory of a Python worker to the machine at the end of a task; the allocators would keep it for the next one."""
    textops.forget_powers()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def let_go() -> None:
    """Drops what operators before have left in this worker; for those that hold nothing between tasks."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        give_back()


def of_worker(name: str, version, make: Callable, keep: str = "") -> object:
    """A value that tasks of one operator share in a worker; all others but the one named ``keep`` are dropped.

    A worker outlives its stage, so what one operator has gathered would otherwise still be there under the next one.
    """
    if gone := [x for x in _HELD if x not in (name, keep)]:
        for other in gone:
            del _HELD[other]
        gc.collect()
        give_back()
    if name not in _HELD or _HELD[name][0] != version:
        _HELD[name] = (version, make())
    return _HELD[name][1]


def texts(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text as string, with the named columns."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def keyed(documents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """doc (long) and text, a document each, and which doc_id and text digest each doc is of (None: doc is doc_id).

    A document is a (doc_id, text). While every id has one text, its id is its key. Otherwise documents are numbered in
    the order of (doc_id, digest), so that keys have the order of ids. A null id has a null key; nulls count as empty texts.
    """
    docs = texts(documents).withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    several = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b")
    if several.limit(1).count() == 0:
        return docs.select(F.col("doc_id").alias("doc"), "text"), None
    different = docs.where("doc_id IS NOT NULL").select("doc_id", "digest").distinct()
    in_order = different.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    names = written(in_order.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "digest"))
    known = docs.join(names, ["doc_id", "digest"], "left")
    return known.select("doc", "text"), names


def others(df: DataFrame, *replaced: str) -> list[str]:
    """Columns of df but those that are replaced; names are compared as Spark does, without case."""
    gone = {c.lower() for c in replaced}
    return [c for c in df.columns if c.lower() not in gone]


def schema_of(df: DataFrame, columns: list[str]) -> str:
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {kind[c]}" for c in columns)
