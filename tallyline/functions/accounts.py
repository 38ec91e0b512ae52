"""Accounts and currencies."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.vocabulary import CURRENCY_DIGITS, CURRENCY_WORDS


def currency_from_account(account: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(account, F.lit("")), r"\D", "")
    known = F.create_map(*[F.lit(x) for pair in CURRENCY_DIGITS.items() for x in pair])
    return F.when(F.length(digits) == 20, F.try_element_at(known, F.substring(digits, 6, 3)))


def currency_from_text(text: Column) -> Column:
    """A known currency named after ВАЛЮТА; else the first of CURRENCY_WORDS that stands as a word."""
    up = F.upper(F.coalesce(text, F.lit("")))
    named = F.regexp_extract(up, r"(?U)ВАЛЮТА[^:]*:\s*(\w{3})", 1)
    codes = F.create_map(*[F.lit(x) for c in sorted(set(CURRENCY_WORDS.values())) for x in (c, c)])
    words = [F.when(up.rlike(rf"(?U)\b{w}\b"), F.lit(c)) for w, c in CURRENCY_WORDS.items()]
    return F.coalesce(F.try_element_at(codes, F.nullif(named, F.lit(""))), *words)


def find_account(text: Column) -> Column:
    """The first 20 digits that stand alone once all white space is gone; empty if none."""
    return F.regexp_extract(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""), r"(?U)\b(\d{20})\b", 1)


def pad_bank_code(code: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(code, F.lit("")), r"\D", "")
    return F.when((digits != "") & (F.length(digits) < 5), F.lpad(digits, 5, "0")).otherwise(digits)
