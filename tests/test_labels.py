"""The dictionary of labels against the same rules for each cell, hot and single texts, and both ways of the join."""

import random

import pytest
from pyspark.sql import functions as F

from tallyline import functions as fn
from tallyline.operators import labels
from tallyline.operators import statements as st
from test_statements import BLOCK, ROW, grid

CELLS = ["Дата", "№ док", "Оборот ДЕБЕТ", "Кредит", "KРEДИT", "Ｄｅｂｅｔ", "Итого за 06.01.2025", "Всего за период", "Количество оборотов", "Входящий остаток на 01.01.2025 5", "", None, "1 234,56", "01.01.2025", "просто текст", "x" * 100, "дебет " * 30, "Счет", "( ) - 12", "№"]


def cells(spark, n=400):
    rng = random.Random(6)
    rows = [(f"f{i % 7}", i % 2, i, [rng.choice(CELLS) if rng.random() < 0.8 else f"имя {i}" for _ in range(rng.randint(0, 9))]) for i in range(n)]
    return spark.createDataFrame(rows, "file string, sheet int, row_idx int, cells array<string>").withColumn("clean", F.transform("cells", fn.clean_text))


@pytest.mark.parametrize("few", [50_000, 0])
def test_dictionary_says_what_cells_say(spark, monkeypatch, few):
    monkeypatch.setattr(labels, "FEW", few)
    g = cells(spark)
    words = labels.entries(g)
    assert 0 < words.count() < len(CELLS)
    got = labels.attached(g, words)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("LocalRelation [folded" in plan) == (few == 0)  # what is sent to all tasks is no plan any more
    left = {(r.file, r.sheet, r.row_idx): r.said for r in got.select("file", "sheet", "row_idx", "said").collect()}
    right = {(r.file, r.sheet, r.row_idx): r.said for r in g.withColumn("said", labels.told(F.col("clean"))).collect()}
    assert left == right and any(right.values()) and len(left) == 400


def test_roles_are_those_of_match_role(spark):
    t = spark.createDataFrame([(i, x) for i, x in enumerate(CELLS)], "id int, text string")
    got = {r.id: r.role for r in labels.role_of_texts(t, labels.dictionary(t)).collect()}
    assert got == {r.id: r.role for r in t.select("id", fn.match_role(F.col("text")).alias("role")).collect()}
    assert got[2] == "debit" and got[16] is None


def test_parse_is_the_same_with_and_without(spark, tmp_path):
    g = grid(spark, a=ROW, b=BLOCK, c=ROW + [[""]] + BLOCK, d=[["nothing"]])
    for n, parse in enumerate((lambda x: x, st.labelled)):
        s = st.sectioned(parse(g))
        s.select("file", "row_idx", "section", "is_header", "control", "data", "body", "layout", "body_start", "body_end", *[f"c_{r}" for r in st.ROLES]).write.parquet(str(tmp_path / str(n)))
    a, b = (sorted(map(tuple, spark.read.parquet(str(tmp_path / str(n))).collect()), key=repr) for n in (0, 1))
    assert a == b and len(a) > 40


def test_words_have_no_digits():
    from tallyline.functions.texts import EXACT, PARTS, markers

    words = [w for w, _ in EXACT + PARTS] + [w for k in labels.KINDS for w in markers(k)] + [labels.TURNS]
    assert not any(c.isdigit() for w in words for c in w)


def test_empty_grid(spark):
    assert st.labelled(grid(spark, a=ROW).limit(0)).collect() == []
