"""Files, the whole parse and its results, on small statements of both layouts."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyline import functions as fn
from tallyline.operators import sinks
from tallyline.operators import statements as st
from tallyline.sources import files

A, B = "20208000100000001001", "20208840100000002001"
HEAD = ["Дата", "№ док", "Дебет", "Кредит", "Счет", "Имя", "МФО", "Назначение платежа"]
ROW = [
    ["АТБ Ипотека-банк"], ["Лицевой счет № " + A + " OOO ROMASHKA"], ["за период с 01.01.2025 по 31.01.2025"], ["ИНН 301234567"], ["Входящий остаток на 01.01.2025   1 000.00"],
    HEAD, ["1", "2", "3", "4", "5", "6", "7", "8"],
    ["05.01.2025", "11", "100,50", "0", "20208000900000003001", "MCHJ ALFA 300000001", "419", "итого за услуги"],
    ["06.01.2025", "12", "", "2 000,00", "20208000900000004001", "BETA", "00420", "за товар"],
    ["06.01.2025", "13", "0", "0", "20208000900000004001", "BETA", "00420", "empty"],
    ["Итого за 06.01.2025", "", "1", "2"], ["Итого", "", "7", "8"], ["Всего за период", "", "100,50", "2 000,00"], ["Количество оборотов", "", "1", "1"], ["Исходящий остаток 2 899.50"],
]
BLOCK = [
    ["Лицевой счет № " + B], HEAD,
    ["07.01.2025", "1", "", "7.00", "20208000900000004001", "", "00420", ""], ["08:15:00", "", "", "", "", "GAMMA 300000009"], ["", "", "", "", "", "first  line"], ["", "", "", "", "", "second line"], [""],
    ["08.01.2025", "2", "3.00", "", "20208000900000005001", "", "7", ""], ["09:00", "", "", "", "", "DELTA"], ["", "", "", "", "", "why"],
    ["Количество документов: 2"], ["Всего", "", "3.00", "6.00"],
]


def grid(spark, **sheets):
    rows = [(f, 0, i, [x or None for x in r] + [None] * (8 - len(r)), [False] * 8) for f, g in sheets.items() for i, r in enumerate(g)]
    return spark.createDataFrame(rows, "file string, sheet int, row_idx int, cells array<string>, numeric array<boolean>")


@pytest.fixture
def keep(spark, tmp_path):
    """Writes a table and reads it again."""
    made = []

    def written(d):
        made.append(str(tmp_path / f"t{len(made)}"))
        d.write.parquet(made[-1])
        return spark.read.parquet(made[-1])

    return written


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    def written(d):
        path = str(tmp_path_factory.mktemp("t") / "p")
        d.write.parquet(path)
        return spark.read.parquet(path)

    return tuple(map(written, st.statements(grid(spark, row=ROW, block=BLOCK, none=[["nothing", "here"]]), keep=written)))


def test_rows(result):
    t = [r.asDict() for r in result[2].where("file = 'row'").orderBy("source_row").collect()]
    assert [(r["transaction_date"], r["document_number"], float(r["debit_amount"]), float(r["credit_amount"]), r["bank_code"], r["payment_purpose"], r["source_row"]) for r in t] == [
        ("05.01.2025 00:00:00", "11", 100.5, 0.0, "00419", "итого за услуги", 8), ("06.01.2025 00:00:00", "12", 0.0, 2000.0, "00420", "за товар", 9),
    ]
    assert t[0]["counterparty_name"] == "20208000900000003001/300000001/MCHJ ALFA"


def test_blocks(result):
    t = result[2].where("file = 'block'").orderBy("source_row").collect()
    assert [(r.transaction_date, r.counterparty_name, r.payment_purpose) for r in t] == [
        ("07.01.2025 08:15:00", "20208000900000004001/300000009/GAMMA", "first line second line"), ("08.01.2025 09:00:00", "20208000900000005001/DELTA", "why"),
    ]


def test_accounts(result):
    a = {r.file: r for r in result[1].collect()}
    r, b = a["row"], a["block"]
    assert (r.account_number, r.account_name, r.client_inn, r.period_from, r.period_to, r.currency, r.layout) == (A, "OOO ROMASHKA", "301234567", "01.01.2025", "31.01.2025", "UZS", "row")
    assert (float(r.stated_debit), float(r.stated_credit), r.stated_debit_count, r.stated_credit_count, float(r.opening_balance), float(r.closing_balance)) == (100.5, 2000.0, 1, 1, 1000.0, 2899.5)
    assert r.checks == {"turnover": "pass", "count": "pass", "balance": "pass"} and r.passed
    assert (b.layout, b.currency, b.stated_count) == ("block", "USD", 2)
    assert b.checks == {"turnover": "fail", "count": "pass", "balance": "skipped"}
    assert {x.file: (x.bank, x.layout, len(x.warnings)) for x in result[0].collect()} == {"row": ("ipoteka", "row", 0), "block": ("unknown", "block", 0), "none": ("unknown", "", 1)}


def test_several_sections_share_the_rows_between(spark, keep):
    f, a, t = st.statements(grid(spark, x=ROW + [[""]] + BLOCK), keep=keep)
    got = a.orderBy("section").collect()
    assert [(r.account_number, r.transaction_count, r.stated_count) for r in got] == [(A, 2, 2), (B, 2, 2)]
    assert [float(x) for x in (got[0].closing_balance, got[0].stated_credit)] == [2899.5, 2000.0]
    assert f.head().layout == "block+row"


def test_wrapped_headers(spark):
    wrapped = [["x"], ["Дата", "№ док", "Дебет", "Кредит", "", "", "", "Назначение"], ["Дата", "", "Дебет", "Кредит", "Счет", "", "МФО", "Назначение"], ["", "", "", "", "", "Имя"], *ROW[7:9]]
    s = st.sectioned(grid(spark, x=wrapped)).where("section = 1").select("header_row", "last_row", "body_start", "c_corr_account", "c_corr_name").distinct().collect()
    assert [tuple(r) for r in s] == [(1, 3, 4, 4, 5)]


def test_json(result):
    f, a, t = result
    p = {r.file: json.loads(r.payload) for r in sinks.payloads(f, a, t).collect()}
    assert p["none"] == []
    assert list(p["row"]) == ["account_number", "currency", "transaction_count", "total_credit", "total_debit", "transactions"]
    assert p["row"]["total_debit"] == 100.5 and [x["document_number"] for x in p["row"]["transactions"]] == ["11", "12"]
    r = {r.file: json.loads(r.report) for r in sinks.reports(f, a).collect()}
    assert r["row"]["accounts"][0]["period"] == "01.01.2025 - 31.01.2025" and r["row"]["accounts"][0]["reconciliation"]["stated"]["count"] == 2
    assert r["none"]["accounts"] == [] and r["none"]["account_count"] == 0
    api = {r.file: json.loads(r.payload) for r in sinks.api_payloads(f, a, t, extended=True).collect()}
    assert api["block"]["reconciliation"]["status"] == "fail" and api["block"]["account"]["closing_balance"] is None
    assert api["none"]["reconciliation"] == {"status": "pass", "accounts": []} and "account" not in api["none"]
    flat = {r.file: json.loads(r.payload) for r in sinks.flat_payloads(f, a, t).collect()}
    assert [x["client_account"] for x in flat["block"]["transactions"]] == [B, B] and flat["none"]["transactions"] == []
    assert {r.file: r.ok for r in sinks.summary(a).collect()} == {"row": True, "block": False}


def test_written(result, tmp_path, spark):
    sinks.write_payloads(sinks.payloads(*result), str(tmp_path / "p"))
    got = {r.stem: json.loads(r.value) for r in spark.read.text(str(tmp_path / "p")).collect()}
    assert got["row"]["account_number"] == A
    sinks.write_accounts(result[1], result[2], str(tmp_path / "a"))
    assert spark.read.text(str(tmp_path / "a")).count() == 2


def xlsx(path):
    sheet = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><dimension ref="A1"/><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>wide</t></is></c></row>
<row r="3"><c r="A3" s="1"><v>43476.5</v></c><c r="B3"><v>1550464.98</v></c><c r="D3" t="b"><v>1</v></c><c r="E3"><v>300</v></c></row>
<row r="9"><c r="A9"/></row></sheetData><mergeCells><mergeCell ref="B1:D1"/><mergeCell ref="A3:A5"/></mergeCells></worksheet>"""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><r><t>ру</t></r><r><t>на</t></r></si></sst>")
        z.writestr("xl/styles.xml", '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)


def test_files(spark, tmp_path):
    xlsx(tmp_path / "a.xlsx")
    (tmp_path / "b.xls").write_bytes("<html><table><tr><td colspan=2>один<br>два<table><tr><td>in</td></tr></table></td><td> x\xa0 y </td></tr></table></html>".encode("cp1251"))
    (tmp_path / "c.csv").write_bytes("Дата;Сумма\n01.01.2025;\"1;5\"\n;\n".encode("cp1251"))
    (tmp_path / "d.bin").write_bytes(b"\x00\x01 not a file")
    (tmp_path / "e.txt").write_bytes(b"")
    (tmp_path / "f.xlsx").write_bytes(b"PK\x03\x04 broken")
    got = {}
    for r in files.read_statements(spark, str(tmp_path)).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append(r)
    a = sorted(got["a.xlsx"], key=lambda r: r.row_idx)
    assert [r.cells for r in a] == [["руна", "wide", "wide", "wide", None], [None] * 5, ["2019-01-11 12:00:00", "1550464.98", None, "True", "300"]]
    assert a[2].numeric == [False, True, False, False, True] and a[0].sheet_name == "One"
    assert [r.cells for r in got["b.xls"]] == [["один\nдваin", None, "x y"]] and got["b.xls"][0].source_format == "html"
    assert [r.cells for r in sorted(got["c.csv"], key=lambda r: r.row_idx)] == [["Дата", "Сумма"], ["01.01.2025", "1;5"]]
    assert got["d.bin"][0].error and got["d.bin"][0].cells is None
    assert "e.txt" not in got
    assert sinks.exit_status(files.read_statements(spark, str(tmp_path)), spark.createDataFrame([], "file string")) == 2


def test_csv_statement_end_to_end(spark, tmp_path, keep):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.csv").write_text("\n".join(";".join(r + [""] * (8 - len(r))) for r in ROW), encoding="utf-8")
    f, a, t = st.statements(files.read_statements(spark, str(tmp_path / "in")), keep=keep)
    assert a.head().passed and t.count() == 2 and f.head().bank == "ipoteka"


def test_empty_input(spark, keep):
    for d in st.statements(grid(spark, x=[]).limit(0), keep=keep):
        assert d.count() == 0


@pytest.mark.parametrize("raw, want", [("1 234,56", 1234.56), ("(1 234.56)", -1234.56), (".00", 0), (None, 0), ("1735000", 1735000), ("1550464.98", 1550464.98), ("2\xa0100,00", 2100), ("1,071,000", 0), ("(-5)", 5), ("1,234", 1234), (",50", 0.5), ("1.234.567", 1234.567)])
def test_amounts(spark, raw, want):
    assert float(spark.createDataFrame([(raw,)], "s string").select(fn.parse_amount(F.col("s"))).head()[0]) == want


def test_rejects_no_exchange_but_by_sheet(spark):
    """One exchange by sheet carries the whole parse of transactions."""
    plan = st.transactions(st.sectioned(grid(spark, row=ROW)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
