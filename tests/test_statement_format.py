"""The statement format: rows equal to read_statements, pushed filters, one file a row, commits and aborts."""

import os
import pickle

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyline.sources import files, statement_format
from tallyline.sources.statement_format import kind_of, register
from test_statements import ROW, xlsx


@pytest.fixture
def folder(spark, tmp_path):
    register(spark)
    (tmp_path / "in" / "sub").mkdir(parents=True)
    xlsx(tmp_path / "in" / "a.xlsx")
    (tmp_path / "in" / "sub" / "b.csv").write_text("\n".join(";".join(r + [""] * (8 - len(r))) for r in ROW), encoding="utf-8")
    (tmp_path / "in" / "c.xls").write_bytes("<html><table><tr><td>один</td></tr></table></html>".encode("cp1251"))
    (tmp_path / "in" / "d.bin").write_bytes(b"\x00\x01 not a file")
    (tmp_path / "in" / "e.txt").write_bytes(b"")
    return str(tmp_path / "in")


def rows(df):
    return sorted((r.file.rsplit("/", 1)[1], r.source_format, r.sheet, r.sheet_name, r.row_idx, r.cells, r.numeric, r.error) for r in df.collect())


def test_reads_what_read_statements_reads(spark, folder):
    whole = spark.read.format("statement").load(folder)
    assert sorted(rows(whole), key=repr) == sorted(rows(files.read_statements(spark, f"{folder}/*.*").unionByName(files.read_statements(spark, f"{folder}/sub"))), key=repr)
    assert spark.read.format("statement").option("maxPartitionBytes", 1).load(folder).rdd.getNumPartitions() == 5
    assert spark.read.format("statement").option("pathGlobFilter", "*.csv").load(f"file://{folder}").select("file").distinct().head().file == f"file://{folder}/sub/b.csv"


def test_filters_are_pushed(spark, folder):
    d = spark.read.format("statement").option("maxPartitionBytes", 1).load(folder).where((F.col("file") == f"{folder}/a.xlsx") & F.col("sheet").isin(0, 1) & (F.col("row_idx") > 0))
    plan = d._jdf.queryExecution().executedPlan().toString()
    above = [line for line in plan.splitlines() if "Filter" in line and "BatchScan" not in line]
    assert above and all("row_idx" in x and "xlsx" not in x and "sheet" not in x for x in above)
    assert d.rdd.getNumPartitions() == 1 and [r.row_idx for r in d.orderBy("row_idx").collect()] == [1, 2]
    assert spark.read.format("statement").load(folder).where("sheet = 7").count() == 0


def test_sniffs_like_the_columns(spark):
    cases = [(b"PK\x03\x04x", "a"), (bytes.fromhex("D0CF11E0A1B11AE1"), "a"), (b"  <HTML>", "a.csv"), (b"x <table", "a"), (b"a", "b.TSV"), (b"a", "b.htm"), (b";;,\t", "b"), (b";;,", "b"), (b"", "a.txt"), (b"", "a.b/c"), (b"x" * 600 + b"<table", "q")]
    df = spark.createDataFrame([(bytearray(c), n) for c, n in cases], "content binary, file string")
    assert [r.k for r in df.select(files.sniff(F.col("content"), F.col("file")).alias("k")).collect()] == [kind_of(c, n) for c, n in cases]


def test_writes_one_file_a_row(spark, tmp_path):
    register(spark)
    to = tmp_path / "out"
    to.mkdir()
    df = spark.range(20).select(F.format_string("s%s.json", "id").alias("name"), F.concat(F.lit('{"n": '), F.col("id").cast("string"), F.lit("}")).alias("content")).repartition(4)
    df.write.format("statement").mode("append").save(str(to))
    assert sorted(os.listdir(to)) == sorted(f"s{i}.json" for i in range(20)) and (to / "s7.json").read_text() == '{"n": 7}'
    # A job that fails leaves what was there.
    bad = df.withColumn("content", F.when(F.col("name") == "s11.json", F.raise_error(F.lit("broken")).cast("string")).otherwise("new"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("statement").mode("append").save(str(to))
    assert sorted(os.listdir(to)) == sorted(f"s{i}.json" for i in range(20)) and (to / "s7.json").read_text() == '{"n": 7}'
    with pytest.raises(Exception, match="one name"):
        df.union(df).write.format("statement").mode("append").save(str(to))
    assert (to / "s7.json").read_text() == '{"n": 7}' and not [x for x in os.listdir(to) if x.startswith("_")]
    df.limit(3).withColumn("content", F.encode(F.lit("é"), "UTF-8")).write.format("statement").mode("overwrite").save(str(to))
    assert len(os.listdir(to)) == 3 and {(to / x).read_text() for x in os.listdir(to)} == {"é"}


def test_a_commit_gets_no_list_of_files(spark, tmp_path, monkeypatch):
    """What a task sends and what a partition holds stays small; the names are lists beside the files, merged a few at a time."""
    monkeypatch.setattr(statement_format, "OPEN_LISTS", 2)
    monkeypatch.setattr(statement_format, "MANY", 3)
    rows = [Row(name=f"{i} имя\t.csv", content=f"{i};x") for i in range(4000)]
    w = statement_format.Writer({"path": str(tmp_path / "to")}, False)
    sent = [w.write(iter(rows[k::7])) for k in range(7)]
    assert all(len(pickle.dumps(x)) < 500 for x in sent)
    w.commit([*sent, None])
    assert sorted(os.listdir(tmp_path / "to")) == sorted(r.name for r in rows) and (tmp_path / "to" / rows[9].name).read_text() == "9;x"
    (tmp_path / "to" / "_temporary-0").mkdir()
    (tmp_path / "to" / "_temporary-0" / "0").write_text("of a writer")
    parts = statement_format.Reader({"path": str(tmp_path / "to"), "maxpartitionbytes": 10 * statement_format.OPEN_BYTES}).partitions()
    assert len(parts) < 60 and sorted(x[1] for p in parts for x in p.files) == sorted(str(tmp_path / "to" / r.name) for r in rows)
    assert sum(len(pickle.dumps(p)) for p in parts) < 40 * len(rows)


def test_files_are_made_in_many_tasks(spark):
    """The table of one row group would have all files made and read in one task."""
    from tallyline.plans.source_queries import read_workbooks

    d = read_workbooks(spark, "/root/testdata/sf0.001")
    assert d.select(F.spark_partition_id().alias("p")).distinct().count() > spark.sparkContext.defaultParallelism
