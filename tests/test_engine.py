"""Paths to results, in one call and from the command line; extraction with a fallback."""

import json

import pytest
from pyspark.sql import functions as F

from tallyline import engine
from tallyline.__main__ import arguments, main, options
from tallyline.operators import extraction
from test_statements import A, B, BLOCK, ROW


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(";".join((c or "") for c in r + [""] * (8 - len(r))) for r in rows), encoding="utf-8")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("in")
    write(f / "a", "s.csv", ROW)
    write(f / "b", "s.csv", BLOCK)
    (f / "b" / "x.bin").write_bytes(b"\x00\x01 no file")
    return f


def test_a_row_for_every_file(spark, tmp_path, monkeypatch):
    """Files without a row are answered too: empty, of blank lines, a page without a table, one that is too large."""
    write(tmp_path / "in", "good.csv", ROW)
    for name, data in (("empty.csv", b""), ("blank.csv", b"\n\n \n"), ("page.html", b"<html><p>no table</p></html>"), ("zero.xlsx", b"")):
        (tmp_path / "in" / name).write_bytes(data)
    with open(tmp_path / "in" / "large.csv", "wb") as f:
        f.truncate(33 * 1024 * 1024)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda _: None)
    c = engine.convert(spark, str(tmp_path / "in"))
    got = {r.file.rsplit("/", 1)[-1]: (r.status, r.payload is not None) for r in c.results().collect()}
    assert got == {"good.csv": (200, True), "empty.csv": (400, False), "blank.csv": (422, False), "page.html": (422, False), "zero.xlsx": (400, False), "large.csv": (413, False)}
    assert c.stored and all(d.is_cached for d in c.stored)
    kept = list(c.stored)
    c.release()
    assert not any(d.is_cached for d in kept)


def test_auto_looks_at_names_and_bytes(spark):
    from tallyline.operators import service

    rows = [("file:/data/reports/st.xlsx", 10, "offline"), ("file:/data/a/report.xlsx", 10, "ai"), ("C:\\block\\a.xlsx", 10, "offline"), ("/multi/a.csv", 10**9, "offline"), ("/a/b.xlsx", 256 * 1024, "ai"), ("/a/b.xlsx", 256 * 1024 - 1, "offline"), ("/dbo/xalq_report.xls", 10**9, "offline"), (None, 1, "offline")]
    df = spark.createDataFrame(rows, "file string, n long, want string")
    assert df.where(service.auto_mode(F.col("file"), F.col("n"), F.lit(True)) != F.col("want")).collect() == []


@pytest.fixture(scope="module")
def conversion(spark, folder):
    c = engine.convert(spark, [str(folder / "a"), str(folder / "b")])
    return engine.Conversion(c.grid, c.files.persist(), c.accounts.persist(), c.transactions.persist())


def test_command_line(spark, conversion, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("tallyline.__main__.convert", lambda *a: conversion)
    code = main(["in", "-o", str(tmp_path / "out"), "--stdout", "--strict"], spark)
    said = capsys.readouterr()
    assert code == 2  # a file could not be read
    assert sorted(json.loads(x)["account_number"] for x in said.out.splitlines()) == [A, B]
    assert "s.csv  [bank=ipoteka, layout=row, 1/1 accounts active]" in said.err and "turnover=fail" in said.err
    written = spark.read.text(str(tmp_path / "out" / "payloads")).collect()
    assert len({r.stem for r in written}) == 2 and {json.loads(r.value)["account_number"] for r in written} == {A, B}


def test_options():
    with pytest.raises(SystemExit):
        options(arguments(["x", "--engine", "ai"]))
    assert options(arguments(["x", "--engine", "auto"])) is None
    o = options(arguments(["x", "--engine", "ai", "--extractor", "test_engine:broken", "--batch-rows", "7", "--no-verify"]))
    assert (o.ask.__name__, o.batch_rows, o.verify) == ("broken", 7, False)


def broken(kind, body, most):
    raise ConnectionError("no network")


def test_results(conversion):
    got = {r.file.rsplit("/", 2)[-2] + "/" + r.file.rsplit("/", 1)[-1]: r for r in conversion.results(strict=True).collect()}
    assert {k: r.status for k, r in got.items()} == {"a/s.csv": 200, "b/s.csv": 422, "b/x.bin": 415} and got["b/x.bin"].error
    assert json.loads(got["a/s.csv"].payload)["account"]["account_number"] == A


def test_errors_of_the_model(spark):
    def refused(kind, body, most):
        raise ConnectionError("no network")

    requests = spark.createDataFrame([("f", 0, 3, "text")], "file string, sheet int, n_rows int, body string")
    got = extraction.asked(requests, "accounts", 10, extraction.Options(refused)).head()
    assert got.error == "ConnectionError: no network" and got.found is None
