"""Expressions inside lambdas share nothing, so what they use several times is worked out once; and odd texts give what they gave."""

import re

import pytest
from pyspark.sql import functions as F

from tallyline import functions as fn
from tallyline.operators import rows
from tallyline.operators import statements as st
from tallyline.vocabulary import MARKERS


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([("a",)], "t string")


@pytest.mark.parametrize(("of", "what", "most"), [
    (fn.parse_amount, "regexp_replace", 6), (fn.parse_counterparty, "split", 5), (fn.parse_datetime, "regexp_replace", 4), (lambda t: fn.row_text(F.array(t)), "regexp_replace", 1),
])
def test_a_part_is_there_once(texts, of, what, most):
    assert len(re.findall(rf"\b{what}\(", plan(texts.select(of(F.col("t")).alias("x"))))) <= most


def test_patterns_are_compiled_once(texts):
    shown = plan(texts.select(st.amount_after(F.col("t"), "opening").alias("x")))
    assert shown.count("regexp_extract(") >= len(MARKERS["opening"]) and not re.search(r"regexp_extract\(t#\d+, lambda", shown)


def test_odd_texts(spark):
    cases = [("5 000.50", "5000.5000"), ("1 2 3", "123.0000"), ("(7,5)", "-7.5000"), ("1.234.567,8", "1234567.8000"), ("", "0.0000"), ("1.2.3", "12.3000"), ("12.", "12.0000"), ("9" * 40, "0.0000")]
    got = spark.createDataFrame(cases, "t string, want string").select(fn.parse_amount(F.col("t")).cast("string").alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    # A time that is none leaves the date; a date that is none leaves nothing.
    days = [("16.03.1960 24:00:55", "1960-03-16 00:00:00"), ("29.02.2021", None), ("за 05.06.2021 г. 10:11", "2021-06-05 10:11:00"), ("1.2.20", "2020-02-01 00:00:00"), ("١٢.٠١.٢٠٢٠", None), ("12", None), ("", None)]
    got = spark.createDataFrame(days, "t string, want string").select(fn.parse_datetime(F.col("t")).cast("string").alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_captions_are_found_by_their_part(spark):
    words = [*MARKERS["section"], "выписка по с№четам", "Ｈｉｓｏｂ qaydnomasi", "ЛИЦЕВОЙ СЧЕТ"]
    got = spark.createDataFrame([(w,) for w in [*words, "оплата", "ALFA 30", None]], "t string").select(rows.is_section_header(F.col("t")).alias("is")).collect()
    assert [r["is"] for r in got] == [True] * len(MARKERS["section"]) + [False, True, True] + [False] * 3
