"""Rows to the last bound before them; days that are written once a batch."""

import os
import random

from pyspark.sql import functions as F

from tallyline.operators import rows
from tallyline.streaming import monitor


def test_swept(spark):
    rng = random.Random(2)
    bounds = [(rng.choice("abc"), rng.randint(0, 40), i, f"s{i}") for i in range(60)] + [("hot", i, i, f"h{i}") for i in range(300)] + [("a", None, 99, "nowhere")]
    own = [(rng.choice("abcd"), rng.choice([None, *range(45)]), i) for i in range(300)] + [("hot", rng.randint(-5, 310), i) for i in range(1000, 2000)]
    b = spark.createDataFrame(bounds, "k string, at int, tie int, section string")
    r = spark.createDataFrame(own, "k string, at int, id int").withColumn("kind", F.lit("x")).withColumn("bound", F.lit("y"))
    out = rows.swept(r, b, ["k"], "at", "tie", "section")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and out.columns == [*r.columns, "section"]
    for x in out.collect():
        last = max(((at, tie, s) for k, at, tie, s in bounds if k == x.k and at is not None and x["at"] is not None and at <= x["at"]), default=(0, 0, None))[2]
        assert x.section == last and (x.kind, x.bound) == ("x", "y")
    assert out.count() == len(own)
    assert rows.swept(r, b.limit(0), ["k"], "at", "tie", "section").where("section IS NOT NULL").count() == 0


def test_a_replayed_batch_writes_nothing(spark, tmp_path):
    source, days = tmp_path / "in", str(tmp_path / "days")
    source.mkdir()
    schema = "ts timestamp, ok boolean"

    def arrive(n):
        spark.createDataFrame([(f"2024-01-0{n}", n % 2 == 0)] * n, "d string, ok boolean").select(F.col("d").cast("timestamp").alias("ts"), "ok").coalesce(1).write.mode("append").parquet(str(source))

    def run(checkpoint):
        s = spark.readStream.schema(schema).parquet(str(source))
        monitor.persist_daily(s, "ts", ~F.col("ok"), days, str(tmp_path / checkpoint), now=True).awaitTermination()

    for n in (1, 2, 3, 4):
        arrive(n)
        run("checkpoint")
    got = sorted((str(r.day), r.total, r.error) for r in monitor.latest_days(spark, days).collect())
    assert got == [("2024-01-01", 1, 1), ("2024-01-02", 2, 0), ("2024-01-03", 3, 3), ("2024-01-04", 4, 0)]
    assert sorted(os.listdir(days)) == ["batch=2", "batch=3"]
    # The last batch is not committed: it is played again, and leaves its folder as it was.
    for name in (".3.crc", "3"):
        os.remove(tmp_path / "checkpoint" / "commits" / name)
    before = {f: os.stat(f"{days}/batch=3/{f}").st_mtime_ns for f in os.listdir(f"{days}/batch=3")}
    run("checkpoint")
    assert before == {f: os.stat(f"{days}/batch=3/{f}").st_mtime_ns for f in os.listdir(f"{days}/batch=3")} and sorted(os.listdir(days)) == ["batch=2", "batch=3"]
    # A batch that stopped half way has no marker: it is not read.
    os.mkdir(f"{days}/batch=9")
    assert sorted((str(r.day), r.total, r.error) for r in monitor.latest_days(spark, days).collect()) == got
