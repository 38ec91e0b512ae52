"""Statement files as rows of cells.

Spark lists and reads the files (``binaryFile``); the format is told by a Column expression; one Arrow batch job turns each
file into rows. A file that cannot be read gives one row with ``error`` and no cells, so others go on.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from decimal import Decimal
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, source_format string, sheet int, sheet_name string, row_idx int, cells array<string>, numeric array<boolean>, error string"
ARROW = pa.schema([("file", pa.string()), ("source_format", pa.string()), ("sheet", pa.int32()), ("sheet_name", pa.string()), ("row_idx", pa.int32()), ("cells", pa.list_(pa.string())), ("numeric", pa.list_(pa.bool_())), ("error", pa.string())])
#: Rows sent to the JVM at a time.
BATCH = 4096
#: Built-in number formats that are dates; encodings in the order they are tried.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
HTML_CODES, CSV_CODES = ("utf-8", "cp1251", "koi8-r", "latin-1"), ("utf-8-sig", "utf-8", "cp1251", "latin-1")


def sniff(content: Column, name: Column) -> Column:
    """SRC1: xlsx, xls, html or csv by first bytes, then by name, then by separators; null if nothing fits."""
    head = F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1"))
    more = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    ext = F.lower(F.regexp_extract(name, r"(\.[^./\\]*)$", 1))
    marks = F.length(more) - F.length(F.translate(more, ";,\t", ""))
    return (
        F.when(F.startswith(content, F.unhex(F.lit("504B0304"))), "xlsx").when(F.startswith(content, F.unhex(F.lit("D0CF11E0A1B11AE1"))), "xls")
        .when(head.rlike(r"^\s*(<\?xml|<!doctype|<html|<table)") | F.contains(head, F.lit("<table")), "html")
        .when(ext.isin(".csv", ".tsv", ".txt"), "csv").when(ext.isin(".htm", ".html"), "html").when(marks > 3, "csv")
    )


def column_index(letters: str) -> int:
    """SRC4: A is 0, AA is 26."""
    n = 0
    for x in letters:
        n = 26 * n + ord(x) - 64
    return n - 1


def shown(value) -> tuple[str | None, bool]:
    """A native value as text that the Column functions parse back exactly, and whether it is a number."""
    if value is None or isinstance(value, str):
        return value, False
    if isinstance(value, bool):
        return str(value), False
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S"), False
    if isinstance(value, dt.time):
        return value.strftime("%H:%M:%S"), False
    text = format(Decimal(repr(value)), "f")
    return (text.rstrip("0").rstrip(".") if "." in text else text), True


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _part(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date or a time."""
    root = _part(book, "xl/styles.xml")
    if root is None:
        return set()
    made = {int(e.get("numFmtId")) for e in root.iter() if _local(e.tag) == "numFmt" and re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")).lower())}
    styles = [e for x in root if _local(x.tag) == "cellXfs" for e in x]
    return {i for i, e in enumerate(styles) if int(e.get("numFmtId", 0)) in DATE_FORMATS | made}


def _cell(c, shared: list[str], dates: set[int], epoch: dt.datetime):
    kind, value = c.get("t", "n"), next((e.text for e in c if _local(e.tag) == "v"), None)
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return value == "1"
    if kind == "d":
        return dt.datetime.fromisoformat(value.removesuffix("Z"))
    if kind != "n":
        return value
    number = float(value) if re.search("[.eE]", value) else int(value)
    if int(c.get("s", 0)) not in dates:
        return number
    when = epoch + dt.timedelta(seconds=round(number * 86400))
    return when.time() if 0 <= number < 1 else when


def read_xlsx(data: bytes) -> Iterator[tuple[str, list[list]]]:
    """SRC2-SRC5: cached values of each worksheet by cell references (a stated dimension is not looked at); merged cells are filled to the right, never down."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        root = _part(book, "xl/sharedStrings.xml")
        shared = [] if root is None else ["".join(t.text or "" for r in si.iter() if _local(r.tag) != "rPh" for t in r if _local(t.tag) == "t") for si in root]
        links = {e.get("Id"): e.get("Target") for e in _part(book, "xl/_rels/workbook.xml.rels")}
        main, dates = _part(book, "xl/workbook.xml"), _date_styles(book)
        old = any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in main)
        epoch = dt.datetime(1904, 1, 1) if old else dt.datetime(1899, 12, 30)
        for sheet in (e for e in main.iter() if _local(e.tag) == "sheet"):
            target = links[next(v for k, v in sheet.attrib.items() if _local(k) == "id")]
            rows, merged = {}, []
            with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
                for _, e in ElementTree.iterparse(f):
                    if _local(e.tag) == "row":
                        at, row = int(e.get("r", len(rows) + 1)) - 1, {}
                        for c in e:
                            ref = re.match("[A-Z]+", c.get("r", ""))
                            row[column_index(ref[0]) if ref else len(row)] = _cell(c, shared, dates, epoch)
                        rows[at] = row
                        e.clear()
                    elif _local(e.tag) == "mergeCell":
                        merged.append(re.match(r"([A-Z]+)(\d+):([A-Z]+)", e.get("ref", "")))
            width = max((c + 1 for r in rows.values() for c in r), default=0)
            out = [[rows.get(i, {}).get(c) for c in range(width)] for i in range(max(rows, default=-1) + 1)]
            for m in filter(None, merged):
                at, first, last = int(m[2]) - 1, column_index(m[1]), column_index(m[3])
                for c in range(first + 1, min(last + 1, width)) if at < len(out) and first < width else ():
                    if out[at][c] is None:
                        out[at][c] = out[at][first]
            yield sheet.get("name"), out


def read_xls(data: bytes) -> Iterator[tuple[str, list[list]]]:
    """SRC6: needs the optional xlrd package."""
    import xlrd

    book = xlrd.open_workbook(file_contents=data, formatting_info=True)
    for sheet in book.sheets():
        rows = []
        for r in range(sheet.nrows):
            row = []
            for c in sheet.row(r):
                try:
                    row.append(xlrd.xldate.xldate_as_datetime(c.value, book.datemode) if c.ctype == xlrd.XL_CELL_DATE else c.value if c.value != "" else None)
                except (ValueError, OverflowError, xlrd.xldate.XLDateError):
                    row.append(c.value)
            rows.append(row)
        for top, _, left, right in sheet.merged_cells:
            for c in range(left + 1, min(right, sheet.ncols)) if top < len(rows) else ():
                rows[top][c] = rows[top][left] if rows[top][c] is None else rows[top][c]
        yield sheet.name, rows


class _Tables(HTMLParser):
    """Rows of tables by depth; text of inner tables also belongs to the cell around them."""

    def __init__(self):
        super().__init__()
        self.tables, self.outer, self.inner, self.found = [], [], [], False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.found = True
            self.tables.append({"row": None, "cell": None})
        elif tag == "br":
            self.handle_data("\n")
        elif self.tables and tag == "tr":
            self._row()
            self.tables[-1]["row"] = []
        elif self.tables and tag in ("td", "th") and self.tables[-1]["row"] is not None:
            self._cell()
            span = dict(attrs).get("colspan") or "1"
            self.tables[-1] |= {"cell": [], "span": int(span) if span.isdigit() else 1}

    def handle_endtag(self, tag):
        if not self.tables:
            return
        if tag in ("td", "th"):
            self._cell()
        elif tag == "tr":
            self._row()
        elif tag == "table":
            self._row()
            self.tables.pop()

    def handle_data(self, data):
        for t in self.tables:
            if t["cell"] is not None:
                t["cell"].append(data)

    def _cell(self):
        t = self.tables[-1]
        if t["cell"] is not None:
            text = "".join(t["cell"]).replace("\xa0", " ")
            lines = (re.sub(r"[ \t]+", " ", x).strip() for x in text.split("\n"))
            t["row"] += [re.sub(r"\n{2,}", "\n", "\n".join(lines).strip()), *[None] * (t["span"] - 1)]
            t["cell"] = None

    def _row(self):
        self._cell()
        t = self.tables[-1]
        if t["row"]:
            (self.outer if len(self.tables) == 1 else self.inner).append(t["row"])
        t["row"] = None


def read_html(data: bytes) -> Iterator[tuple[str, list[list]]]:
    """SRC7, SRC8: outer tables as one sheet; inner ones if the outer have no rows."""
    named = re.search(rb"""charset=["']?([\w\-]+)""", data[:2048], re.IGNORECASE)
    parser = _Tables()
    parser.feed(_decoded(data, ([named[1].decode()] if named else []) + list(HTML_CODES)))
    parser.close()
    if not parser.found:
        raise ValueError("no <table> element")
    yield "html", parser.outer or parser.inner


def _decoded(data: bytes, codes) -> str:
    for code in codes:
        try:
            return data.decode(code)
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("latin-1")


def read_csv(data: bytes) -> Iterator[tuple[str, list[list]]]:
    """SRC9: all cells are texts."""
    text = _decoded(data, CSV_CODES)
    try:
        mark = csv.Sniffer().sniff(text[:8192], delimiters=";,\t|").delimiter
    except csv.Error:
        mark = ";" if text.count(";") > text.count(",") else ","
    yield "csv", list(csv.reader(io.StringIO(text), delimiter=mark))


READERS = {"xlsx": read_xlsx, "xls": read_xls, "html": read_html, "csv": read_csv}


def _sheets(data: bytes, kind: str | None) -> tuple[str, list]:
    """SRC10: the told format first, then the others; a page without tables is not tried further."""
    if kind is None:
        raise ValueError("cannot tell the format of this file")
    first = None
    for k in [kind, *(x for x in READERS if x != kind)]:
        try:
            return k, list(READERS[k](data))
        except Exception as e:  # noqa: BLE001 - whatever a broken file raises, another reader may take it
            if first is None and k == "html" and isinstance(e, ValueError):
                raise
            first = first or e
    raise ValueError(f"failed to read as {kind}: {first}")


def trimmed(rows: list[list]) -> list[list]:
    """SRC11: without blank rows at the end and blank columns at the right."""
    full = lambda v: v is not None and str(v).strip() != ""
    last = max((i for i, r in enumerate(rows) if any(map(full, r))), default=-1)
    width = max((c + 1 for r in rows for c, v in enumerate(r) if full(v)), default=0)
    return [r[:width] + [None] * (width - len(r)) for r in rows[: last + 1]]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pending: list[tuple] = []
    for batch in batches:
        for name, data, kind in zip(*(batch.column(i).to_pylist() for i in range(3))):
            try:
                kind, sheets = _sheets(data, kind)
                for s, (title, rows) in enumerate(sheets):
                    for r, row in enumerate(trimmed(rows)):
                        cells = [shown(v) for v in row]
                        pending.append((name, kind, s, title, r, [c for c, _ in cells], [n for _, n in cells], None))
                        if len(pending) >= BATCH:
                            yield _batch(pending)
                            pending = []
            except Exception as e:  # noqa: BLE001 - becomes the file's error
                pending.append((name, kind, 0, None, 0, None, None, f"{type(e).__name__}: {e}"))
    yield _batch(pending)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)


def read_statements(spark: SparkSession, path: str | list[str], suffix: str = "*") -> DataFrame:
    """SRC12, SRC13: rows of all sheets of all files under ``path``; ``error`` where a file is not readable. A file fits one task's memory."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path)
    return parsed(raw.select(F.col("path").alias("file"), "content"))


def listing(spark: SparkSession, path: str | list[str], suffix: str = "*") -> DataFrame:
    """file, length of every file under ``path``; contents are not read. A scan passes over files without a byte, so names come from its file index."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path)
    names = [(re.sub(r"^([A-Za-z0-9+.\-]+):///", r"\1:/", unquote(p)),) for p in raw.inputFiles()]
    held = raw.select(F.col("path").alias("file"), "length")
    return spark.createDataFrame(names, "file string").join(held, "file", "left").select("file", F.coalesce("length", F.lit(0).cast("long")).alias("length"))


def parsed(files: DataFrame) -> DataFrame:
    """The same for a table with ``file`` and ``content``."""
    return files.select("file", "content", sniff(F.col("content"), F.col("file")).alias("kind")).mapInArrow(_rows, SCHEMA)
