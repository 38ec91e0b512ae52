"""Queries of files, rich statements and their results, and equal SQL. Files are made of tables, as bytes, and read back."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyline import functions as fn
from tallyline.engine import Conversion, convert_grid
from tallyline.operators import ledger, rows, sinks, statements
from tallyline.plans.queries import ACCOUNT_SQL, LEDGER, MONEY, account, ledger_rows, once, plain, query, shared, table
from tallyline.sources import files, table_function
from tallyline.sources.statement_format import persist_stream, register, stored


def workbook(key: int, name: str) -> bytes:
    """A workbook with a wrong dimension, shared and inline texts, a date, numbers, a gap, merged ranges and a second sheet."""
    sheet = f"""<worksheet xmlns="m"><dimension ref="A1"/><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>{name}</t></is></c></row>
<row r="3"><c r="A3" s="1"><v>{43476 + key}</v></c><c r="B3"><v>{key}.25</v></c><c r="D3" t="b"><v>1</v></c><c r="AA3"><v>{key}</v></c></row>
<row r="9"><c r="A9"/></row></sheetData><mergeCells><mergeCell ref="B1:D1"/><mergeCell ref="A3:A5"/></mergeCells></worksheet>"""
    second = f'<worksheet xmlns="m"><sheetData><row r="1"><c r="A1"><v>{key}</v></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Two" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst><si><r><t>№ </t></r><r><t>{key}</t></r></si></sst>")
        z.writestr("xl/styles.xml", '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/worksheets/sheet2.xml", second)
    return out.getvalue()


def page(key: int, name: str) -> bytes:
    """Sibling tables in windows-1251 that says so: a nested table, a break, a no-break space, a wide cell."""
    return f'<html><meta charset="windows-1251"><table><tr><td colspan=2>Счёт<br> {name}<table><tr><td>in</td></tr></table></td><td> x\xa0{key} </td></tr></table><table><tr><td>second</td></tr></table></html>'.encode("cp1251")


def separated(key: int, name: str) -> bytes:
    """Semicolons in windows-1251, a quoted cell, blank lines at the end."""
    return f'Дата;Сумма;Имя\n01.01.2025;"{key};5";{name}\n;;\n\n'.encode("cp1251")


def made(spark, sf_dir, make, ending):
    """file, content: a file for each customer."""

    def run(batches):
        for b in batches:
            keys, names = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([f"/in/{k}{ending}" for k in keys]), pa.array([make(k, n) for k, n in zip(keys, names, strict=True)], pa.binary())], names=["file", "content"])

    # Far more comes out than goes in: by the size of the table, a scan or a coalesced exchange would make all files in one task.
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey").mapInArrow(run, "file string, content binary")


def shown(grid, *more):
    return grid.select("file", "sheet", *more, "row_idx", F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit("-"))), "|").alias("cells"), F.col("error").isNotNull().alias("failed"))


@query("""WITH r AS (SELECT c_custkey AS k, c_name AS n FROM customer)
SELECT '/in/' || k || '.xlsx' AS file, 0 AS sheet, 'One' AS sheet_name, 0 AS row_idx, '№ ' || k || '|' || n || '|' || n || '|' || n || repeat('|-', 23) AS cells, false AS failed FROM r
UNION ALL SELECT '/in/' || k || '.xlsx', 0, 'One', 1, '-' || repeat('|-', 26), false FROM r
UNION ALL SELECT '/in/' || k || '.xlsx', 0, 'One', 2, strftime(DATE '1899-12-30' + CAST(43476 + k AS INTEGER), '%Y-%m-%d') || ' 00:00:00|' || k || '.25|-|True' || repeat('|-', 22) || '|' || k, false FROM r
UNION ALL SELECT '/in/' || k || '.xlsx', 1, 'Two', 0, CAST(k AS VARCHAR), false FROM r""")
def read_workbooks(spark, sf_dir):
    """SRC2-SRC5, SRC11-SRC13, AGG11: sheets of every workbook, whatever their declared size."""
    return shown(files.parsed(made(spark, sf_dir, workbook, ".xlsx")), "sheet_name")


@query("""WITH r AS (SELECT c_custkey AS k, c_name AS n FROM customer)
SELECT '/in/' || k || '.xls' AS file, 0 AS sheet, 0 AS row_idx, 'Счёт' || chr(10) || n || 'in|-|x ' || k AS cells, false AS failed FROM r UNION ALL SELECT '/in/' || k || '.xls', 0, 1, 'second|-|-', false FROM r""")
def read_pages(spark, sf_dir):
    """SRC7, SRC8: html that is named xls."""
    return shown(files.parsed(made(spark, sf_dir, page, ".xls")))


@query("""WITH r AS (SELECT c_custkey AS k, c_name AS n FROM customer)
SELECT '/in/' || k || '.csv' AS file, 0 AS sheet, 0 AS row_idx, 'Дата|Сумма|Имя' AS cells, false AS failed FROM r UNION ALL SELECT '/in/' || k || '.csv', 0, 1, '01.01.2025|' || k || ';5|' || n, false FROM r""")
def read_separated(spark, sf_dir):
    """SRC9"""
    return shown(files.parsed(made(spark, sf_dir, separated, ".csv")))


@query("""WITH r AS (SELECT c_custkey AS k, c_name AS n FROM customer)
SELECT k || '.csv' AS file, 0 AS sheet, 0 AS row_idx, 'Дата|Сумма|Имя' AS cells, false AS failed FROM r UNION ALL SELECT k || '.csv', 0, 1, '01.01.2025|' || k || ';5|' || n, false FROM r""")
def statement_files(spark, sf_dir):
    """2.P, SNK5: files written one a row, and read again, by the statement format."""
    folder = f"{shared(spark)}/statements-{uuid.uuid4().hex}"
    register(spark)
    made(spark, sf_dir, separated, ".csv").select(F.regexp_extract("file", "([^/]*)$", 1).alias("name"), "content").write.format("statement").mode("append").save(folder)
    grid = spark.read.format("statement").load(folder).where("sheet = 0")
    return shown(grid.withColumn("file", F.regexp_extract("file", "([^/]*)$", 1)))


@query("""WITH r AS (SELECT c_custkey AS k, c_name AS n FROM customer)
SELECT k || '.csv' AS file, 0 AS row_idx, 'Дата|Сумма|Имя' AS cells, NULL AS error FROM r WHERE k % 5 <> 0 UNION ALL SELECT k || '.csv', 1, '01.01.2025|' || k || ';5|' || n, NULL FROM r WHERE k % 5 <> 0
UNION ALL SELECT k || '.csv', 0, NULL, 'ValueError: the file has no rows' FROM r WHERE k % 5 = 0""")
def statement_file_stream(spark, sf_dir):
    """SRC12, SRC13, 2.P: files that arrive in two runs of a stream, each once; those without rows become dead letters."""
    folder = f"{shared(spark)}/arrivals-{uuid.uuid4().hex}"
    register(spark)
    k = F.regexp_extract("file", r"(\d+)\.csv$", 1).cast("long")
    csvs = made(spark, sf_dir, separated, ".csv").select(k.alias("k"), F.concat(k.cast("string"), F.lit(".csv")).alias("name"), F.when(k % 5 != 0, F.col("content")).alias("content"))
    for part in (0, 1):
        csvs.where(F.col("k") % 2 == part).select("name", "content").write.format("statement").mode("append").save(f"{folder}/in")
        grid = spark.readStream.format("statement").option("log", f"{folder}/log").load(f"{folder}/in")
        persist_stream(grid, f"{folder}/kept", f"{folder}/checkpoint", now=True).awaitTermination()
    both = stored(spark, f"{folder}/kept", False).unionByName(stored(spark, f"{folder}/kept", True))
    return both.select(F.regexp_extract("file", "([^/]*)$", 1).alias("file"), "row_idx", F.array_join("cells", "|").alias("cells"), "error")


@query("""WITH r AS (SELECT c_custkey AS k, c_name AS n FROM customer), p AS (SELECT page_id AS k, 'p' || page_id || CASE page_id % 3 WHEN 1 THEN '.csv' ELSE '.html' END AS file FROM pages)
SELECT '/in/' || k || '.xls' AS file, 0 AS sheet, 0 AS row_idx, 'Счёт' || chr(10) || n || 'in|-|x ' || k AS cells FROM r UNION ALL SELECT '/in/' || k || '.xls', 0, 1, 'second|-|-' FROM r
UNION ALL SELECT file, 0, 0, '№|' || k FROM p WHERE k % 3 = 0 UNION ALL SELECT file, 0, 1, 'end|-' FROM p WHERE k % 3 = 0
UNION ALL SELECT file, 0, 0, '№|page' FROM p WHERE k % 3 = 1 UNION ALL SELECT file, 0, 1, '1|' || k FROM p WHERE k % 3 = 1
UNION ALL SELECT file, 0, 0, 'ValueError: no <table> element' FROM p WHERE k % 3 = 2""")
def statement_cells_sql(spark, sf_dir):
    """2.P, SRC7, SRC9: the table function in SQL, over bytes of statements and over texts: web pages with a table, csv, pages without a table."""
    table_function.register(spark)
    own, web = (f"{n}_{uuid.uuid4().hex}" for n in ("own", "web"))
    made(spark, sf_dir, page, ".xls").createOrReplaceTempView(own)
    k = F.col("page_id")
    content = F.when(k % 3 == 0, F.concat(F.lit("<table><tr><td>№</td><td>"), k.cast("string"), F.lit("</td></tr><tr><td>end</td></tr></table>"), "html"))
    content = content.when(k % 3 == 1, F.concat(F.lit("№;page\n1;"), k.cast("string"), F.lit("\n"))).otherwise(F.col("html"))
    table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), k.cast("string"), F.when(k % 3 == 1, ".csv").otherwise(".html")).alias("file"), content.alias("content")).createOrReplaceTempView(web)
    cells = "coalesce(array_join(transform(c.cells, x -> coalesce(x, '-')), '|'), c.error) AS cells"
    return spark.sql(f"""SELECT c.file, sheet, row_idx, {cells} FROM {own} o, LATERAL statement_cells(o.file, o.content) c
    UNION ALL SELECT c.file, sheet, row_idx, {cells} FROM {web} w, LATERAL statement_cells(w.file, w.content) c""")


@query("SELECT '/in/' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.bin' ELSE '.xls' END AS file, CASE c_custkey % 3 WHEN 1 THEN 1 ELSE 0 END AS failed FROM customer")
def read_with_fallback(spark, sf_dir):
    """SRC1, SRC10, SVC6: a broken workbook is read as the text that it is, unknown bytes fail alone, a page that is named xls is read."""
    good = made(spark, sf_dir, page, "")
    k = F.regexp_extract("file", r"(\d+)$", 1).cast("long") % 3
    content = F.when(k == 0, F.concat(F.unhex(F.lit("504B0304")), F.encode(F.lit("broken"), "UTF-8"))).when(k == 1, F.unhex(F.lit("0001020300"))).otherwise(F.col("content"))
    named = good.select(F.concat("file", F.when(k == 0, ".xlsx").when(k == 1, ".bin").otherwise(".xls")).alias("file"), content.alias("content"))
    return files.parsed(named).groupBy("file").agg(F.max(F.col("error").isNotNull().cast("int")).alias("failed"))


HEADER = ("Дата", "№ док", "Дебет", "Кредит", "Счет", "Имя", "МФО", "Назначение платежа")


def rich(spark, sf_dir):
    """A sheet a customer with two sections: orders that are done (F) as rows, the others as blocks of three rows.

    Captions: account with name, period, INN and opening balance above the first, the account alone above the second;
    a numbering row, a day's subtotal, a total, the total of the period, counts of both sides and the closing balance below.
    """
    none = F.lit(None).cast("string")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("done"), F.col("o_totalprice").cast(MONEY).alias("p"), "o_orderdate", "o_orderpriority", (F.col("o_orderkey") % 2 == 0).alias("debit"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), account(F.col("c_custkey"), F.col("c_nationkey")).alias("a"), "c_name")
    day, money = F.date_format("o_orderdate", "dd.MM.yyyy"), F.translate(F.format_number("p", 2), ",", " ")
    key = F.col("o_orderkey").cast("string")
    to = F.concat(F.lit("20208000"), F.lpad(key, 12, "0"))
    line = lambda *x: F.array(*[F.lit(i) if isinstance(i, str) else i for i in x], *[none] * (8 - len(x)))
    one = F.array(line(day, key, F.when(F.col("debit"), money), F.when(~F.col("debit"), money), to, F.concat(F.lit("ALFA 30"), F.lpad(F.right(key, F.lit(7)), 7, "0")), "419", F.col("o_orderpriority")))
    block = F.array(
        line(day, key, F.when(F.col("debit"), money), F.when(~F.col("debit"), money), to, none, "00420"), line(F.date_format("o_orderdate", "HH:mm:ss"), none, none, none, none, F.concat(F.lit("BETA "), key)),
        line(none, none, none, none, none, F.concat(F.lit("for  "), "o_orderpriority")),
    )
    lines = F.when(F.col("done"), one).otherwise(block)
    body = o.select("k", F.when(F.col("done"), 1).otherwise(2).alias("s"), F.lit(1).alias("z"), "o_orderkey", F.posexplode(lines).alias("i", "cells"))
    sums = lambda side: F.coalesce(F.sum(F.when(side, F.col("p"))), F.lit(0)).cast(MONEY)
    t = o.groupBy("k", "done").agg(sums(F.col("debit")).alias("d"), sums(~F.col("debit")).alias("c"), F.count_if("debit").cast("string").alias("nd"), F.count_if(~F.col("debit")).cast("string").alias("nc")).join(c, "k")
    text = lambda c: F.col(c).cast("string")
    top = F.array(
        line(F.concat(F.lit("Лицевой счет № "), "a", F.lit(" OOO "), F.translate("c_name", "#0123456789", ""), F.lit("LTD"))), line("за период с 01.01.1990 по 31.12.2030"), line("ИНН 301234567"),
        line("Входящий остаток на 01.01.1990   1 000 000 000.00"), line(*HEADER), line("1", "2", "3", "4", "5", "6", "7", "8"),
    )
    again = F.array(line(F.concat(F.lit("Лицевой счет № "), F.lit("30"), F.substring("a", 3, 18), F.lit(" OOO SECOND"))), line(*HEADER))
    end = F.array(
        line("Итого за 06.01.2025", none, "1", "2"), line("Итого", none, "7", "8"), line("Всего за период", none, text("d"), text("c")), line("Количество оборотов", none, F.col("nd"), F.col("nc")),
        line(F.concat(F.lit("Исходящий остаток "), (F.lit(1_000_000_000).cast(MONEY) + F.col("c") - F.col("d")).cast("string"))), line(none),
    )
    s = F.when(F.col("done"), 1).otherwise(2).alias("s")
    zero = F.lit(0).cast("long").alias("o_orderkey")
    g = body.union(t.select("k", s, F.lit(0).alias("z"), zero, F.posexplode(F.when(F.col("done"), top).otherwise(again)).alias("i", "cells")))
    g = g.union(t.select("k", s, F.lit(2).alias("z"), zero, F.posexplode(end).alias("i", "cells")))
    n = F.row_number().over(Window.partitionBy("k").orderBy("s", "z", "o_orderkey", "i")) - 1
    return g.select(F.concat(F.lit("/in/"), F.col("k").cast("string"), F.lit(".xlsx")).alias("file"), F.lit(0).alias("sheet"), n.alias("row_idx"), "cells", F.transform("cells", lambda x: F.lit(False)).alias("numeric"))


#: A section of one block has the layout of rows, so the lines below its only row are not read.
ORDERS = "w AS (SELECT *, o_orderstatus = 'F' OR count(*) FILTER (o_orderstatus <> 'F') OVER (PARTITION BY o_custkey) = 1 AS as_row FROM orders)"


def parsed(spark, sf_dir, keep):
    c = convert_grid(rich(spark, sf_dir), keep=keep)
    return Conversion(c.grid, *map(keep, (c.files, c.accounts, c.transactions)))


def converted(spark, sf_dir):
    return once(spark, sf_dir, parsed)


@query(f"""WITH {ORDERS} SELECT '/in/' || o_custkey || '.xlsx' AS file, CAST(o_orderkey AS VARCHAR) AS document_number, strftime(CASE WHEN as_row THEN date_trunc('day', o_orderdate) ELSE o_orderdate END, '%d.%m.%Y %H:%M:%S') AS transaction_date,
CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0.0 END AS debit_amount, CASE WHEN o_orderkey % 2 = 0 THEN 0.0 ELSE o_totalprice END AS credit_amount, CASE WHEN o_orderstatus = 'F' THEN '00419' ELSE '00420' END AS bank_code,
'20208000' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || CASE WHEN o_orderstatus = 'F' THEN '/30' || lpad(right(CAST(o_orderkey AS VARCHAR), 7), 7, '0') || '/ALFA' WHEN as_row THEN '/20208000' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') ELSE '/BETA ' || o_orderkey END AS counterparty_name,
CASE WHEN o_orderstatus = 'F' THEN '30' || lpad(right(CAST(o_orderkey AS VARCHAR), 7), 7, '0') ELSE '' END AS counterparty_inn, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority WHEN as_row THEN '' ELSE 'for ' || o_orderpriority END AS payment_purpose FROM w""")
def sectioned_transactions(spark, sf_dir):
    """STR4, STR6, STR7, DT6, CMP3, PRD5: two sections a sheet, of rows and of blocks."""
    return plain(converted(spark, sf_dir).transactions.select("file", "document_number", "transaction_date", "debit_amount", "credit_amount", "bank_code", "counterparty_name", "counterparty_inn", "payment_purpose"))


PARTS = f"""t AS (SELECT o_custkey AS k, o_orderstatus = 'F' AS done, count(*) AS n, count(*) FILTER (o_orderkey % 2 = 0) AS nd, count(*) FILTER (o_orderkey % 2 <> 0) AS nc,
coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderkey % 2 = 0), 0) AS d, coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderkey % 2 <> 0), 0) AS c FROM orders GROUP BY 1, 2),
r AS (SELECT t.*, {ACCOUNT_SQL} AS a, c_name, c_nationkey FROM t JOIN customer ON c_custkey = k)"""


@query(f"""WITH {PARTS} SELECT '/in/' || k || '.xlsx' AS file, CASE WHEN done THEN a ELSE '30' || right(a, 18) END AS account_number, CASE c_nationkey % 3 WHEN 0 THEN 'UZS' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency,
CASE WHEN done THEN 'OOO ' || regexp_replace(c_name, '[#0-9]', '', 'g') || 'LTD' ELSE 'OOO SECOND' END AS account_name, CASE WHEN done THEN '301234567' ELSE '' END AS client_inn, CASE WHEN done THEN '01.01.1990' ELSE '' END AS period_from, CASE WHEN done THEN '31.12.2030' ELSE '' END AS period_to,
CASE WHEN done OR n = 1 THEN 'row' ELSE 'block' END AS layout, n AS transaction_count, CAST(d AS DOUBLE) AS total_debit, CAST(c AS DOUBLE) AS total_credit, CAST(d AS DOUBLE) AS stated_debit, CAST(c AS DOUBLE) AS stated_credit, nd AS stated_debit_count, nc AS stated_credit_count,
CASE WHEN done THEN 1e9::DOUBLE END AS opening_balance, CAST(1000000000 + c - d AS DOUBLE) AS closing_balance, 0::BIGINT AS undated, 'balance=' || CASE WHEN done THEN 'pass' ELSE 'skipped' END || ' count=pass turnover=pass' AS checks, '' AS messages FROM r""")
def sectioned_accounts(spark, sf_dir):
    """MET1-MET6, CTL1-CTL6, AGG5, REC1-REC4, STR9, ORD7: metadata, stated figures and checks of both sections."""
    a = converted(spark, sf_dir).accounts
    marks = F.array_join(F.transform(F.array_sort(F.map_entries("checks")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ").alias("checks")
    names = ("file", "account_number", "currency", "account_name", "client_inn", "period_from", "period_to", "layout", "transaction_count", "total_debit", "total_credit", "stated_debit", "stated_credit", "stated_debit_count", "stated_credit_count", "opening_balance", "closing_balance", "undated")
    return plain(a.select(*names, marks, F.array_join("messages", ";").alias("messages")))


NUMBER = "regexp_replace(CAST(CAST({} AS DECIMAL(28,4)) AS VARCHAR), '\\.?0+$', '')"
ROWS = ORDERS + ", x AS (SELECT *, '{\"transaction_date\":\"' || strftime(CASE WHEN as_row THEN date_trunc('day', o_orderdate) ELSE o_orderdate END, '%d.%m.%Y %H:%M:%S') || '\",\"document_number\":\"' || o_orderkey || '\",\"credit_amount\":' || CASE WHEN o_orderkey % 2 = 0 THEN '0' ELSE " + NUMBER.format("o_totalprice") + " END || ',\"debit_amount\":' || CASE WHEN o_orderkey % 2 = 0 THEN " + NUMBER.format("o_totalprice") + " ELSE '0' END || ',\"counterparty_name\":\"20208000' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || CASE WHEN o_orderstatus = 'F' THEN '/30' || lpad(right(CAST(o_orderkey AS VARCHAR), 7), 7, '0') || '/ALFA' WHEN as_row THEN '/20208000' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') ELSE '/BETA ' || o_orderkey END || '\",\"counterparty_account\":\"20208000' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '\",\"bank_code\":\"' || CASE WHEN o_orderstatus = 'F' THEN '00419' ELSE '00420' END || '\",\"payment_purpose\":\"' || CASE WHEN o_orderstatus = 'F' THEN o_orderpriority WHEN as_row THEN '' ELSE 'for ' || o_orderpriority END || '\"}' AS j FROM w)"


@query(f"""WITH {PARTS}, {ROWS}, l AS (SELECT o_custkey AS k, o_orderstatus = 'F' AS done, string_agg(j, ',' ORDER BY o_orderkey) AS js FROM x GROUP BY 1, 2),
a AS (SELECT r.k, r.done, '{{"account_number":"' || CASE WHEN r.done THEN a ELSE '30' || right(a, 18) END || '","currency":"' || CASE c_nationkey % 3 WHEN 0 THEN 'UZS' WHEN 1 THEN 'USD' ELSE 'EUR' END || '","transaction_count":' || n || ',"total_credit":' || {NUMBER.format("c")} || ',"total_debit":' || {NUMBER.format("d")} || ',"transactions":[' || js || ']}}' AS j FROM r JOIN l ON r.k = l.k AND r.done = l.done)
SELECT '/in/' || k || '.xlsx' AS file, CASE WHEN count(*) = 1 THEN min(j) ELSE '[' || string_agg(j, ',' ORDER BY done DESC) || ']' END AS payload FROM a GROUP BY k""")
def payload_json(spark, sf_dir):
    """SNK1-SNK4, AGG7, AGG12: the payload of each file, letter by letter."""
    return converted(spark, sf_dir).payloads()


@query("WITH t AS (SELECT o_custkey AS k, count(*) AS n, count(DISTINCT o_orderstatus = 'F') AS parts FROM orders GROUP BY 1) SELECT '/in/' || k || '.xlsx' AS file, CAST(parts AS VARCHAR) AS accounts, CAST(n AS VARCHAR) AS rows_of_json, 'pass' AS status, CAST(parts AS VARCHAR) AS reported, 'unknown' AS bank FROM t")
def api_and_report_json(spark, sf_dir):
    """SNK6-SNK8, SVC4, SVC5: figures inside the service's payload, the flat payload and the report."""
    c = converted(spark, sf_dir)
    get = lambda j, p: F.get_json_object(j, p)
    flat = c.flat().select("file", F.json_array_length(get("payload", "$.transactions")).cast("string").alias("rows_of_json"))
    report = c.reports().select("file", get("report", "$.active_account_count").alias("reported"), get("report", "$.bank").alias("bank"))
    api = c.api_payloads().select("file", get("payload", "$.account_count").alias("accounts"), get("payload", "$.reconciliation.status").alias("status"))
    return api.join(flat, "file").join(report, "file")


@query("""WITH t AS (SELECT o_custkey AS k, o_orderstatus = 'F' AS done, count(*) AS n FROM orders GROUP BY 1, 2), h AS (SELECT k, count(*) AS parts, string_agg(DISTINCT CASE WHEN done OR n = 1 THEN 'row' ELSE 'block' END, '+' ORDER BY CASE WHEN done OR n = 1 THEN 'row' ELSE 'block' END) AS layout FROM t GROUP BY 1)
SELECT '/in/' || k || '.xlsx' AS file, k || '.xlsx  [bank=unknown, layout=' || layout || ', ' || parts || '/' || parts || ' accounts active]' AS first_line, 1 + parts AS n_lines FROM h""")
def summary_lines(spark, sf_dir):
    """SNK9: the summary's text."""
    c = converted(spark, sf_dir)
    lines = sinks.summary_text(c.files, c.accounts)
    return lines.groupBy("file").agg(F.min_by("line", "place").alias("first_line"), F.count(F.lit(1)).alias("n_lines"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN '' WHEN 2 THEN p_partkey || '.5' ELSE 'N 1/2' END AS number FROM part")
def document_numbers(spark, sf_dir):
    """TXT10"""
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(".0"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit(".5"))).when(k % 4 == 3, "  N   1/2 ")
    return table(spark, sf_dir, "part").select("p_partkey", fn.document_number(text, k % 4 != 3).alias("number"))


@query("SELECT p_partkey, p_partkey % 3 <> 2 AS is_date, CASE WHEN p_partkey % 3 = 2 THEN p_name ELSE '' END AS kept FROM part")
def dates_and_noise(spark, sf_dir):
    """DT4, PRD9: dates are dates, and no name."""
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, "31.03.20").when(k == 1, "за 05.06.2021 г.").otherwise(F.concat(F.lit("OOO "), "p_name"))
    t = table(spark, sf_dir, "part").withColumn("t", text)
    return t.select("p_partkey", fn.looks_like_date(F.col("t")).alias("is_date"), F.when(statements.is_noise(F.col("t")), "").otherwise(F.substring("t", 5, 1000)).alias("kept"))


@query("SELECT p_partkey, p_partkey % 4 IN (0, 1) AS numbering FROM part")
def numbering_rows(spark, sf_dir):
    """PRD5"""
    k = F.col("p_partkey") % 4
    cells = F.when(k == 0, F.array(*map(F.lit, ("1", "2", " 3 ")))).when(k == 1, F.array(*map(F.lit, ("10", "", "11", "12")))).when(k == 2, F.array(*map(F.lit, ("1", "2")))).otherwise(F.array(F.lit("1"), F.lit("2"), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", rows.is_numbering(cells).alias("numbering"))


@query("SELECT event_id, event_type || ' ' || CAST(user_id AS VARCHAR) AS text FROM events")
def row_texts(spark, sf_dir):
    """TXT8, WIN6: equal neighbours count once, empty cells not at all."""
    cells = F.array("event_type", F.lit(None).cast("string"), "event_type", F.lit("  "), F.concat(F.lit(" "), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", fn.row_text(cells).alias("text"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'debit' WHEN 1 THEN 'credit' WHEN 2 THEN 'mfo' WHEN 3 THEN 'date' END AS role FROM part")
def compatible_labels(spark, sf_dir):
    """TXT2, TXT3, TXT5: full width, ligatures, letters of the other alphabet, marks apart."""
    labels = F.array(*map(F.lit, ("Ｄｅｂｅｔ", "KРEДИT", "ﬁlial", "№ Дата:", "просто")))
    return table(spark, sf_dir, "part").select("p_partkey", fn.match_role(F.get(labels, (F.col("p_partkey") % 5).cast("int"))).alias("role"))


@query(f"WITH {LEDGER} SELECT custkey, count(*) FILTER (custkey % 2 = 0) AS undated, count(*) AS transaction_count FROM l GROUP BY 1")
def undated_counts(spark, sf_dir):
    """AGG5"""
    r = ledger_rows(spark, sf_dir).withColumn("transaction_date", F.when(F.col("custkey") % 2 == 1, F.col("transaction_date")))
    return ledger.account_totals(r, "custkey").select("custkey", "undated", "transaction_count")
