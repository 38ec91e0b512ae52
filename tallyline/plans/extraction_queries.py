"""Queries of the extraction by an injected model, and equal SQL. The model is a fixed function that reads the rendered rows."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from tallyline.operators import extraction, ledger, statements
from tallyline.plans.queries import ACCOUNT_SQL, LINES, lines, once, plain, query, sheets, table


def reader(kind: str, body: str, most: int, schema: dict) -> tuple[str, str]:
    """Answers as a model would, from the shape of ``queries.sheets``, if it has the fields of the schema; account numbers that divide by 9 get broken answers."""
    fields = set(schema["properties"][kind]["items"]["required"])
    rows = [line.split("\t") for line in body.split("\n") if re.match(r"\d+\t", line)]
    if kind == "accounts":
        number = re.sub(r"\D", "", rows[0][1])
        total = next(r for r in reversed(rows) if r[1] == "Итого")
        key = int(number[9:17])
        if key % 9 == 0:
            return [("max_tokens", "{"), ("refusal", ""), ("end", " "), ("end", "no json")][key // 9 % 4]
        data = [int(r[0]) for r in rows if re.match(r"\d{2}\.\d{2}\.\d{4}", r[1])]
        account = {"account_number": "№ " + number, "currency": "", "account_name": " A  B ", "period_from": "", "period_to": "", "opening_balance": "", "closing_balance": "", "stated_debit_total": total[3], "stated_credit_total": total[4], "stated_count": len(data), "header_row": 1, "first_data_row": min(data), "last_data_row": int(total[0]) - 1, "layout": "row", "columns": {"date": 0}}
        return "end", json.dumps({"accounts": [account]}) if set(account) == fields else "other fields"
    a, b = map(int, re.search(r"rows (\d+) to (\d+)", body).groups())
    out = []
    for r in rows:
        if a <= int(r[0]) <= b:
            debit, credit = r[3], r[4]
            out += [{"source_row": int(r[0]), "transaction_date": r[1], "document_number": r[2], "debit_amount": debit, "credit_amount": credit or "0", "counterparty_name": "", "counterparty_account": r[5], "counterparty_inn": "", "bank_code": "419", "payment_purpose": r[6]}] * 2
    return "end", json.dumps({"transactions": out}) if all(set(t) == fields for t in out) else "other fields"


OPTIONS = extraction.Options(reader, batch_rows=4, schema=True)
READ = "o_custkey % 9 <> 0"


def answered(spark, sf_dir, keep):
    return tuple(map(keep, extraction.extracted(sheets(spark, sf_dir), OPTIONS, keep)))


@query(f"SELECT CAST(o_custkey AS VARCHAR) AS file, strftime(o_orderdate, '%d.%m.%Y %H:%M:%S') AS transaction_date, CAST(o_orderkey AS VARCHAR) AS document_number, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END AS debit_amount, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS credit_amount, '20208000' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS counterparty_name, '00419' AS bank_code, o_orderpriority AS payment_purpose, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS INTEGER) AS source_row FROM orders WHERE {READ}")
def extraction_transactions(spark, sf_dir):
    """LLM2-LLM6: every transaction is answered twice and counts once."""
    _, _, t = once(spark, sf_dir, answered)
    return plain(t.select("file", "transaction_date", "document_number", "debit_amount", "credit_amount", "counterparty_name", "bank_code", "payment_purpose", "source_row"))


@query(f"""WITH t AS (SELECT o_custkey, count(*) AS n, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F'), 0) AS DOUBLE) AS d, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus <> 'F'), 0) AS DOUBLE) AS c FROM orders GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS file, {ACCOUNT_SQL} AS account_number, CASE c_nationkey % 3 WHEN 0 THEN 'UZS' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency, 'A B' AS account_name, n AS transaction_count, d AS total_debit, c AS total_credit, CAST(NULL AS DOUBLE) AS opening_balance, true AS passed FROM t JOIN customer ON c_custkey = o_custkey WHERE {READ}""")
def extraction_accounts(spark, sf_dir):
    """LLM2, LLM6, NUM4: figures that the model left empty stay null."""
    _, a, _ = once(spark, sf_dir, answered)
    return plain(a.select("file", "account_number", "currency", "account_name", "transaction_count", "total_debit", "total_credit", "opening_balance", "passed"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS file, CASE (o_custkey // 9) % 4 WHEN 0 THEN 'the answer was cut off' WHEN 1 THEN 'the model refused' WHEN 2 THEN 'the answer is empty' ELSE 'the answer is not readable' END AS error FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 9 = 0)")
def extraction_errors(spark, sf_dir):
    """LLM5"""
    e, _, _ = once(spark, sf_dir, answered)
    return e.select("file", "error")


@query(f"WITH {LINES}, y AS (SELECT doc_id, row_idx, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS c FROM x) SELECT doc_id, row_idx, CAST(row_idx AS VARCHAR) || chr(9) || chr(9) || CASE WHEN length(c) > 300 THEN left(c, 300) || '…' ELSE c END AS line FROM y WHERE c <> ''")
def rendered_rows(spark, sf_dir):
    """TXT12, ORD8: three cells, of which the outer ones are empty."""
    r = lines(spark, sf_dir).select("doc_id", "row_idx", extraction.rendered(F.col("row_idx"), F.array(F.lit(""), "line", F.lit(None).cast("string"))).alias("line"))
    return r.where("line IS NOT NULL")


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n FROM x WHERE trim(regexp_replace(line, '\\s+', ' ', 'g')) <> '' AND row_idx BETWEEN 2 AND 5 GROUP BY 1")
def data_row_indices(spark, sf_dir):
    """PRD11"""
    g = lines(spark, sf_dir).select(F.col("doc_id").alias("file"), F.lit(0).alias("sheet"), "row_idx", F.array("line").alias("cells"))
    a = g.select("file", "sheet").distinct().select("*", F.lit(1).alias("section"), F.lit(2).alias("first_row"), F.lit(5).alias("last_row"), *[F.lit("").alias(c) for c in ("layout", "mapping", "account_number", "currency")])
    return extraction.data_rows(g, a).groupBy(F.col("file").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0.0::DOUBLE ELSE p_retailprice END AS value FROM part")
def decimal_or_none(spark, sf_dir):
    """NUM4"""
    text = F.when(F.col("p_partkey") % 3 == 0, "  ").when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.format_number("p_retailprice", 2))
    return table(spark, sf_dir, "part").select("p_partkey", extraction.decimal_or_none(text).cast("double").alias("value"))


SIDES = """a AS (SELECT c_nationkey AS file, c_custkey AS k, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS d FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
m AS (SELECT file, k, CASE WHEN k % 8 = 1 THEN n + 1 ELSE n END AS n, CASE WHEN k % 8 = 2 THEN d + 1 ELSE d END AS d FROM a WHERE k % 8 <> 0 AND file % 2 = 0 UNION ALL SELECT * FROM a WHERE file % 2 = 1),
p AS (SELECT * FROM a WHERE k % 8 <> 7 OR file % 2 = 1)"""


def _sides(spark, sf_dir):
    """Two extractions of accounts, a file a nation: in even ones the model misses, adds and changes some."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("f"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit(0).cast("decimal(18,2)").alias("credit_amount"), F.col("o_totalprice").cast("decimal(18,2)").alias("debit_amount"))
    a = ledger.account_totals(o, "k").join(c, "k").withColumns({"file": F.col("f").cast("string"), "account_number": F.col("k").cast("string")})
    even = F.col("f") % 2 == 0
    m = a.where(~even | (F.col("k") % 8 != 0)).withColumns({"transaction_count": F.col("transaction_count") + (even & (F.col("k") % 8 == 1)).cast("long"), "total_debit": F.col("total_debit") + (even & (F.col("k") % 8 == 2)).cast("int")})
    return m, a.where(~even | (F.col("k") % 8 != 7))


@query(f"""WITH {SIDES}, j AS (SELECT coalesce(m.file, p.file) AS file, coalesce(m.k, p.k) AS k, CASE WHEN m.k IS NULL THEN 'only parsed' WHEN p.k IS NULL THEN 'only from the model' WHEN m.n <> p.n THEN 'count differ' WHEN m.d <> p.d THEN 'totals differ' END AS s, CASE WHEN m.k IS NULL THEN 0 WHEN p.k IS NULL THEN 1 ELSE 2 END AS o FROM m FULL JOIN p ON m.k = p.k)
SELECT CAST(file AS VARCHAR) AS file, coalesce(string_agg('account ' || k || ': ' || s, ';' ORDER BY o, CAST(k AS VARCHAR)) FILTER (s IS NOT NULL), '') AS warnings FROM j GROUP BY 1""")
def extraction_warnings(spark, sf_dir):
    """SET1, JON1: the accounts of one side only, sorted, then those that differ."""
    return extraction.warnings(extraction.compared(*_sides(spark, sf_dir))).select("file", F.array_join("warnings", ";").alias("warnings"))


@query(f"WITH {SIDES}, x AS (SELECT CAST(file AS VARCHAR) AS file, k, n FROM p WHERE file % 2 = 0 UNION ALL SELECT CAST(file AS VARCHAR), k, n FROM m WHERE file % 2 = 1) SELECT file, CAST(k AS VARCHAR) AS account_number, n AS transaction_count FROM x")
def extraction_fallback(spark, sf_dir):
    """LLM6, JON2: files with a difference are taken as parsed."""
    m, p = _sides(spark, sf_dir)
    a, _ = extraction.chosen((m, m.select("file")), (p, p.select("file")))
    return a.select("file", "account_number", "transaction_count")


@query("SELECT CAST(o_custkey AS VARCHAR) AS file, part, n FROM (SELECT DISTINCT o_custkey FROM orders) CROSS JOIN (VALUES ('preamble', 2::BIGINT), ('footer', 2::BIGINT)) t(part, n)")
def framed_rows(spark, sf_dir):
    """JON3: the rows around each body, through the parse."""
    return statements.framed(statements.sectioned(sheets(spark, sf_dir))).groupBy("file", "part").agg(F.count(F.lit(1)).alias("n"))
