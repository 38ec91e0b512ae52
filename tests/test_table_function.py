"""statement_cells in SQL: beside rows and over a partitioned table."""

from tallyline.sources import table_function

PAGE = "<html><meta charset=windows-1251><table><tr><td>Счёт</td><td> 1 </td></tr></table></html>"
ROWS = [
    ("a.html", PAGE.encode("cp1251").decode("cp1251"), None), ("b.csv", "Дата;Сумма\n01.01.2025;5\n;\n", None), ("c.html", "<html>no table</html>", None), ("d", "neither", None), ("e.csv", "", None), ("f.csv", None, None),
    (None, "<table><tr><td>x</td></tr></table>", None),
]
WANT = [
    ("a.html", 0, 0, ["Счёт", "1"], False), ("b.csv", 0, 0, ["Дата", "Сумма"], False), ("b.csv", 0, 1, ["01.01.2025", "5"], False), ("c.html", 0, 0, None, True), ("d", 0, 0, None, True), (None, 0, 0, ["x"], False),
]


def rows(df):
    return sorted(((r.file, r.sheet, r.row_idx, r.cells, r.error is not None) for r in df.collect()), key=repr)


def test_statement_cells(spark):
    table_function.register(spark)
    spark.createDataFrame(ROWS, "file string, content string, other int").createOrReplaceTempView("held")
    assert rows(spark.sql("SELECT c.* FROM held h, LATERAL statement_cells(h.file, h.content) c")) == sorted(WANT, key=repr)
    assert rows(spark.sql("SELECT * FROM statement_cells(TABLE(held) PARTITION BY file)")) == sorted(WANT, key=repr)
    beside = spark.sql("SELECT c.* FROM held h, LATERAL statement_cells(h.file, h.content) c")
    assert "Exchange" not in beside._jdf.queryExecution().executedPlan().toString()
    spark.sql("SELECT file, CAST(encode(content, 'UTF-8') AS BINARY) AS content FROM held WHERE file = 'b.csv'").createOrReplaceTempView("bytes_held")
    assert rows(spark.sql("SELECT c.* FROM bytes_held h, LATERAL statement_cells(h.file, h.content) c")) == [w for w in WANT if w[0] == "b.csv"]
    assert spark.sql("SELECT c.* FROM (SELECT * FROM held LIMIT 0) h, LATERAL statement_cells(h.file, h.content) c").count() == 0
