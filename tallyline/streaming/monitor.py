"""Call metrics and state changes, in batch and as streams."""

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def daily(calls: DataFrame, ts: str, failed: Column) -> DataFrame:
    """Calls, successes and errors of each day."""
    return calls.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("total"), F.count_if(~failed).alias("success"), F.count_if(failed).alias("error"))


def retained(days: DataFrame, keep: int = 90) -> DataFrame:
    """ORD4: the newest days."""
    return days.orderBy(F.desc("day")).limit(keep)


def daily_stream(calls: DataFrame, ts: str, failed: Column, late: str = "1 day") -> DataFrame:
    """daily() over a stream, closed once a day is ``late`` past."""
    t = calls.withWatermark(ts, late)
    days = t.groupBy(F.window(ts, "1 day")).agg(F.count(F.lit(1)).alias("total"), F.count_if(~failed).alias("success"), F.count_if(failed).alias("error"))
    return days.select(F.to_date("window.start").alias("day"), "total", "success", "error")


def transitions(checks: DataFrame, key: list[str], order: list[str], is_up: Column) -> DataFrame:
    """WIN7: checks at which a target went down or up again; a target starts up."""
    w = Window.partitionBy(*key).orderBy(*order)
    return checks.withColumn("is_up", is_up).withColumn("was_up", F.lag("is_up", 1, True).over(w)).where("is_up <> was_up")


def _batches(spark: SparkSession, path: str) -> tuple[object, dict[int, object]]:
    """The file system, and the folders of batches that are complete."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.listStatus(at) if store.exists(at) else []
    folders = {int(f.getPath().getName()[6:]): f.getPath() for f in found if f.getPath().getName().startswith("batch=")}
    return store, {n: p for n, p in folders.items() if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}


def persist_daily(calls: DataFrame, ts: str, failed: Column, path: str, checkpoint: str, keep: int = 90, now: bool = False):
    """SVC12: the newest days of a stream of calls, as a table that each batch replaces as a whole (``latest_days`` reads it).

    A batch is a folder named by its id, complete once its marker is there. A replayed batch that is complete leaves its folder as it is;
    when one is complete, those before the last two are removed. now: what is there, then stop.
    """

    def write(days: DataFrame, batch: int) -> None:
        store, complete = _batches(days.sparkSession, path)
        if batch not in complete:
            retained(days, keep).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        else:  # the state of the stream has to move on
            days.write.format("noop").mode("overwrite").save()
        for n in sorted({*complete, batch})[:-2]:
            store.delete(complete[n], True)

    w = daily(calls, ts, failed).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if now else w).start()


def latest_days(spark: SparkSession, path: str) -> DataFrame:
    """What ``persist_daily`` wrote last; no other batch is read."""
    last = max(_batches(spark, path)[1].items())[1].toString()
    return spark.read.parquet(last).select("day", "total", "success", "error")


def alerts_stream(checks: DataFrame, key: str, order: list[str], is_up: Column) -> DataFrame:
    """STM1 over a stream: a row each time that a target goes down or up again; a target starts up. The state of a target is its last check.

    checks: key, order columns and what is_up reads. In a batch a target's checks count in their order.
    """
    c = checks.withColumn("is_up", is_up).select(key, *order, "is_up")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in c.schema.fields)

    def step(_, frames, state):
        f = pd.concat(list(frames)).sort_values(order)
        was = [state.get[0] if state.exists else True, *f["is_up"].tolist()[:-1]]
        state.update((bool(f["is_up"].iloc[-1]),))
        yield f[f["is_up"] != pd.Series(was, f.index)]

    return c.groupBy(key).applyInPandasWithState(step, shape, "is_up boolean", "append", "NoTimeout")
