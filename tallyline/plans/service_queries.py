"""Queries of the service, its metrics and streams, and equal SQL. Calls are made from events; files from documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyline.operators import service
from tallyline.plans.queries import DAYS, query, shared, table
from tallyline.streaming import monitor, reports

ALIASES = ("ai", "model-ai", " Offline", "model_offline", "AUTO", "rules", "other", "")


def _pick(n):
    return "CASE " + n + " " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ALIASES)) + " END"


@query(f"""WITH a AS (SELECT event_id, {_pick("event_id % 9")} AS model, {_pick("(event_id // 9) % 9")} AS name, {_pick("(event_id // 81) % 9")} AS engine FROM events),
b AS (SELECT event_id, lower(trim(coalesce(nullif(model, ''), nullif(name, ''), nullif(engine, '')))) AS m FROM a)
SELECT event_id, CASE WHEN m IN ('ai', 'model-ai') THEN 'ai' WHEN m IN ('offline', 'model_offline', 'rules') THEN 'offline' WHEN m = 'auto' THEN 'auto' END AS mode FROM b""")
def mode_normalise(spark, sf_dir):
    """SVC7: every combination of the three parameters."""
    names = F.array(*map(F.lit, ALIASES))
    at = lambda d: F.get(names, (F.floor(F.col("event_id") / d) % 9).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", service.mode(at(1), at(9), at(81)).alias("mode"))


NAMES = ("a.csv", "IPOTEKA.xlsx", "dbo.xls", "st.xlsx", "MULTI.HTML", "report.xlsx", "mkb block.xls")


@query("""WITH f AS (SELECT doc_id, lower(CASE doc_id % 7 WHEN 0 THEN 'a.csv' WHEN 1 THEN 'IPOTEKA.xlsx' WHEN 2 THEN 'dbo.xls' WHEN 3 THEN 'st.xlsx' WHEN 4 THEN 'MULTI.HTML' WHEN 5 THEN 'report.xlsx' ELSE 'mkb block.xls' END) AS n, coalesce(strlen(text), 0) * 64 AS b FROM documents),
c AS (SELECT doc_id, CASE WHEN n LIKE '%ipotek%' OR n LIKE '%mkb%' THEN 'offline' WHEN n LIKE '%dbo%' OR n LIKE '%multi%' OR n LIKE '%report%' OR b // 1024 >= 256 THEN 'ai' ELSE 'offline' END AS cli, n FROM f)
SELECT doc_id, CASE WHEN n LIKE '%.csv' OR n LIKE '%.html' THEN 'offline' ELSE cli END AS served, cli, 'offline' AS without FROM c""")
def auto_routing(spark, sf_dir):
    """SVC8: by name and size (64 bytes for each of the text's), as served, from the command line, and without an extractor."""
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % 7).cast("int"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) * 64
    route = lambda has, ending: service.auto_mode(name, size, F.lit(has), ending)
    return table(spark, sf_dir, "documents").select("doc_id", route(True, True).alias("served"), route(True, False).alias("cli"), route(False, True).alias("without"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 400 WHEN event_id % 7 = 1 THEN 413 WHEN event_id % 5 = 0 THEN 415 WHEN event_id % 5 = 1 OR event_id % 4 = 0 OR (event_id % 2 = 1 AND event_type = 'error') THEN 422 ELSE 200 END AS status FROM events""")
def upload_guards(spark, sf_dir):
    """SVC9"""
    i = F.col("event_id")
    size = F.when(i % 7 == 0, 0).when(i % 7 == 1, service.MOST_BYTES + 1).otherwise(service.MOST_BYTES)
    kind, error = F.when(i % 5 != 0, "csv"), F.when(i % 5 == 1, "broken")
    return table(spark, sf_dir, "events").select("event_id", service.upload_status(size, kind, error, i % 4, F.col("event_type") != "error", i % 2 == 1).alias("status"))


CALLS = """c AS (SELECT CAST(ts AS DATE) AS day, CASE user_id % 5 WHEN 0 THEN '/formats' WHEN 1 THEN '/convert' WHEN 2 THEN '/convert/transactions' WHEN 3 THEN '/convert/batch' ELSE '/wp-login' END AS path,
CASE WHEN event_id % 11 = 0 THEN 401 WHEN event_id % 13 = 0 THEN NULL WHEN event_type = 'error' THEN 422 WHEN event_type = 'click' THEN 302 ELSE 200 END AS status FROM events),
k AS (SELECT CAST(day AS VARCHAR) AS day, coalesce(status BETWEEN 200 AND 399, false) AS ok FROM c WHERE path <> '/wp-login' AND coalesce(status <> 401, true)),
d AS (SELECT day, count(*) AS total, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS error FROM k GROUP BY 1)"""


def calls(spark, sf_dir):
    path = F.coalesce(F.get(F.array(*map(F.lit, ("/formats", "/convert", "/convert/transactions", "/convert/batch"))), (F.col("user_id") % 5).cast("int")), F.lit("/wp-login"))
    i = F.col("event_id")
    status = F.when(i % 11 == 0, 401).when(i % 13 == 0, F.lit(None)).when(F.col("event_type") == "error", 422).when(F.col("event_type") == "click", 302).otherwise(200)
    return service.tracked(table(spark, sf_dir, "events").select("ts", path.alias("path"), status.alias("status")), "path", "status")


def call_days(spark, sf_dir):
    return monitor.daily(calls(spark, sf_dir), "ts", F.col("failed")).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {CALLS} SELECT * FROM d")
def tracked_calls(spark, sf_dir):
    """SVC11"""
    return call_days(spark, sf_dir)


@query(f"WITH {CALLS} SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(success) AS BIGINT) AS success, CAST(sum(error) AS BIGINT) AS error FROM d")
def metrics_totals(spark, sf_dir):
    """AGG9"""
    return service.totals(call_days(spark, sf_dir))


@query(f"WITH {CALLS}, t AS (SELECT coalesce(max(total), 0) AS total, coalesce(max(success), 0) AS success, coalesce(max(error), 0) AS error FROM d WHERE day = '2024-01-07') SELECT t.total AS today, CAST((SELECT sum(total) FROM d) AS BIGINT) AS all_days, CAST((SELECT count(*) FROM d) AS INTEGER) AS n_days, 'API status: UP' || chr(10) || 'Today - calls: ' || total || ', success: ' || success || ', errors: ' || error AS up, 'API status: DOWN' || chr(10) || 'Metrics unavailable.' AS down FROM t")
def metrics_and_status(spark, sf_dir):
    """SVC2, STM4"""
    m = service.metrics(call_days(spark, sf_dir), F.lit("2024-01-07"))
    none = F.lit(None).cast("struct<total:bigint,success:bigint,error:bigint>")
    return m.select(F.col("today.total").alias("today"), F.col("totals.total").alias("all_days"), F.size("days").alias("n_days"), service.status_text(F.col("today"), F.lit(True)).alias("up"), service.status_text(none, F.lit(False)).alias("down"))


@query("""WITH f AS (SELECT unnest(['.xlsx', '.xlsm', '.xls', '.xls (HTML)', '.htm', '.html', '.csv', '.tsv', 'ai', 'offline', 'auto', 'aab', 'agrobank', 'aloqabank', 'anorbank', 'asiaalliance', 'davrbank', 'hamkorbank', 'infinbank', 'ipakyuli', 'ipoteka', 'kapitalbank', 'mikrokredit', 'nbu', 'orientfinans', 'sqb', 'tengebank', 'trastbank', 'turonbank', 'xalqbank']) AS known)
SELECT known, coalesce(n, 0) AS n_pages FROM f LEFT JOIN (SELECT regexp_extract(lower(url), '([.][a-z]+)$', 1) AS known, count(*) AS n FROM pages GROUP BY 1) USING (known)""")
def known_formats(spark, sf_dir):
    """SVC3, ORD7: what is known, and pages that end like it."""
    known = service.formats(spark).select(F.explode(F.concat("input_formats", "modes", "known_banks")).alias("known"))
    ends = table(spark, sf_dir, "pages").groupBy(F.regexp_extract(F.lower("url"), "([.][a-z]+)$", 1).alias("known")).agg(F.count(F.lit(1)).alias("n"))
    return known.join(ends, "known", "left").select("known", F.coalesce("n", F.lit(0).cast("long")).alias("n_pages"))


def _stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark) -> str:
    """A new folder that driver and executors share."""
    return f"{shared(spark)}/stream-{uuid.uuid4().hex}"


@query(f"SELECT * FROM ({DAYS}) ORDER BY day DESC LIMIT 20")
def metrics_stream(spark, sf_dir):
    """SVC12, STM2: the events as a stream, kept as days by its sink."""
    folder = _folder(spark)
    monitor.persist_daily(_stream(spark, sf_dir), "ts", F.col("event_type") == "error", f"{folder}/days", f"{folder}/checkpoint", keep=20, now=True).awaitTermination()
    return monitor.latest_days(spark, f"{folder}/days").withColumn("day", F.col("day").cast("string"))


@query(DAYS + " HAVING CAST(CAST(ts AS DATE) AS VARCHAR) < (SELECT CAST(CAST(max(ts) AS DATE) - 1 AS VARCHAR) FROM events)")
def daily_stream_closed(spark, sf_dir):
    """STM2: days that the watermark has closed."""
    folder = _folder(spark)
    s = monitor.daily_stream(_stream(spark, sf_dir), "ts", F.col("event_type") == "error")
    s.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(s.schema).parquet(f"{folder}/out").withColumn("day", F.col("day").cast("string"))


@query("SELECT event_id, user_id, is_up FROM (SELECT event_id, user_id, event_type <> 'error' AS is_up, lag(event_type <> 'error', 1, true) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE is_up <> was")
def health_alert_stream(spark, sf_dir):
    """STM1 as a stream with state."""
    folder = _folder(spark)
    s = monitor.alerts_stream(_stream(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") != "error")
    s.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(s.schema).parquet(f"{folder}/out").select("event_id", "user_id", "is_up")


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS d, CAST(ts + INTERVAL 15 HOUR AS DATE) AS day, event_type = 'error' AS bad FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
f AS (SELECT user_id, min(day) AS a FROM e GROUP BY 1), w AS (SELECT CAST(max(ts) - INTERVAL 10 HOUR AS DATE) AS b FROM events),
g AS (SELECT user_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM f, w),
c AS (SELECT user_id, day, count(*) AS n, count(*) FILTER (NOT bad) AS s, count(*) FILTER (bad) AS x, count(*) FILTER (d = day) AS tn, count(*) FILTER (d = day AND NOT bad) AS ts, count(*) FILTER (d = day AND bad) AS tx FROM e GROUP BY 1, 2),
r AS (SELECT user_id, day, coalesce(tn, 0) AS tn, coalesce(ts, 0) AS ts, coalesce(tx, 0) AS tx, sum(coalesce(n, 0)) OVER o AS n, sum(coalesce(s, 0)) OVER o AS s, sum(coalesce(x, 0)) OVER o AS x FROM g LEFT JOIN c USING (user_id, day) WINDOW o AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, CAST(day AS VARCHAR) AS day, 'Daily report - ' || CAST(day AS VARCHAR) || chr(10) || 'Calls: ' || tn || chr(10) || 'Successful: ' || ts || chr(10) || 'Errors: ' || tx || chr(10) || chr(10) || 'All-time - calls: ' || CAST(n AS BIGINT) || ', success: ' || CAST(s AS BIGINT) || ', errors: ' || CAST(x AS BIGINT) AS text FROM r""")
def daily_report_stream(spark, sf_dir):
    """STM2: a report of each user a day at nine, by timers, also on days without events."""
    folder = _folder(spark)
    s = reports.daily_reports_stream(_stream(spark, sf_dir), "user_id", "ts", F.col("event_type") == "error", 9, "1 hour")
    s.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    r = spark.read.schema(s.schema).parquet(f"{folder}/out")
    figures = lambda x: [F.col(f"{x}{f}") for f in reports.FIGURES]
    return r.select("user_id", "day", reports.report_text(F.col("day"), figures(""), figures("all_")).alias("text"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type <> 'error') AS s, count(*) FILTER (event_type = 'error') AS x FROM events GROUP BY 1)
SELECT event_id, user_id, 'API status: UP' || chr(10) || 'Today - calls: ' || n || ', success: ' || s || ', errors: ' || x AS reply FROM events JOIN d ON CAST(ts AS DATE) = day
WHERE event_type IN ('error', 'click') AND user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0)""")
def command_replies_stream(spark, sf_dir):
    """STM3, STM4: events as updates that come twice; those that ask, from allowed users, are answered once, with the figures of their day."""
    folder = _folder(spark)
    text = F.when(F.col("event_type") == "error", "/status").when(F.col("event_type") == "click", " /stats ").otherwise(F.col("event_type"))
    updates = _stream(spark, sf_dir).select("event_id", "user_id", F.to_date("ts").alias("day"), text.alias("text"))
    allowed = table(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    s = reports.commands_stream(updates.union(updates), allowed, "user_id", "event_id")
    s.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    days = monitor.daily(table(spark, sf_dir, "events"), "ts", F.col("event_type") == "error")
    asked = spark.read.schema(s.schema).parquet(f"{folder}/out").join(days, "day")
    return asked.select("event_id", "user_id", service.status_text(F.struct("total", "success", "error"), F.lit(True)).alias("reply"))
