"""Reports at an hour and commands, over several runs of a stream."""

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyline.streaming import reports


def run(stream, out, checkpoint):
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_reports_at_an_hour(spark, tmp_path):
    source, out, hour = tmp_path / "in", str(tmp_path / "out"), 9
    source.mkdir()
    schema = "target string, ts timestamp, ok boolean"
    rng, start = random.Random(4), datetime(2024, 3, 1)
    calls = [(rng.choice("ab"), start + timedelta(minutes=rng.randrange(4 * 24 * 60)), rng.random() < 0.6) for _ in range(400)]
    calls += [("quiet", datetime(2024, 3, 1, 9), True), ("early", datetime(2024, 3, 2, 8, 59, 59), False), (None, start, True), ("a", None, True)]
    last = datetime(2024, 3, 12, 10, 30)  # the stream jumps over days
    parts = [[c for c in calls if c[1] is None or c[1] < datetime(2024, 3, 3, 4)], [c for c in calls if c[1] and c[1] >= datetime(2024, 3, 3, 4)], [("late", last, True)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        s = spark.readStream.schema(schema).parquet(str(source))
        run(reports.daily_reports_stream(s, "target", "ts", ~F.col("ok"), hour, "1 hour"), out, str(tmp_path / "checkpoint"))
    want = set()
    for target in ("a", "b", "quiet", "early"):
        own = [(at, ok) for t, at, ok in calls if t == target and at]
        at = datetime(2024, 3, 1, hour)
        while at <= last - timedelta(hours=1):
            day, all_time = [ok for t, ok in own if t < at and t.date() == at.date()], [ok for t, ok in own if t < at]
            if all_time:
                want.add((target, str(at.date()), len(day), sum(day), len(day) - sum(day), len(all_time), sum(all_time), len(all_time) - sum(all_time)))
            at += timedelta(days=1)
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r[1] for r in got if r[0] == "quiet"} == {f"2024-03-{d:02}" for d in range(2, 13)}


def test_report_text(spark):
    n = [F.lit(i).cast("long") for i in range(6)]
    assert spark.range(1).select(reports.report_text(F.lit("2024-03-01"), n[:3], n[3:])).head()[0] == "Daily report - 2024-03-01\nCalls: 0\nSuccessful: 1\nErrors: 2\n\nAll-time - calls: 3, success: 4, errors: 5"


def test_updates_sent_again_are_answered_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    schema = "update_id int, chat_id string, text string"
    allowed = spark.createDataFrame([("1",), ("2",), ("2",)], "chat_id string")
    first = [(1, "1", "/status"), (2, "9", "/status"), (3, "1", " /stats "), (3, "1", "/stats"), (4, "2", "hello"), (5, "2", None), (6, None, "/stats"), (None, "1", "/stats")]
    again = [(3, "1", "/stats"), (1, "1", "/status"), (7, "2", "/stats"), (8, "1", "/status")]
    for part in (first, again, first + again, [(9, "1", "/stats")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        run(reports.commands_stream(spark.readStream.schema(schema).parquet(str(source)), allowed), out, str(tmp_path / "checkpoint"))
    got = Counter((r.update_id, r.chat_id) for r in spark.read.parquet(out).collect())
    assert got == {(1, "1"): 1, (3, "1"): 1, (7, "2"): 1, (8, "1"): 1, (9, "1"): 1}
