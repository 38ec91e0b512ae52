"""Amounts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.texts import let

AMOUNT = "decimal(28,4)"
#: Spaces that are dropped from amounts.
SPACES = "       \t"
#: Digits in groups, with a fraction or none; the characters of amounts, with a digit (blanks are passed over, and one break of a line at the end that is no blank).
PLAIN = r"^\d[\d ]*(\.\d+)?\z"
LIKE = rf"^[.,'()+\-\s{SPACES}]*\d[\d.,'()+\-\s{SPACES}]*[\u0085\u2028\u2029]?[\s{SPACES}]*\z"


def parse_amount(raw: Column, null_is_zero: bool = True) -> Column:
    """Exact amount of a text; 0 for anything that is not an amount, and for null (unless null_is_zero is off).

    The later of comma and dot is the decimal mark. A lone comma before exactly three characters groups thousands;
    several dots do, but for the last. Parentheses make an amount negative.
    """
    s = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), f"[{SPACES}]+", ""))
    zero = F.lit(0).cast(AMOUNT)
    amount = let(s, lambda x: F.when(x == "", zero).when(x.rlike(PLAIN), F.coalesce(F.replace(x, F.lit(" "), F.lit("")).try_cast(AMOUNT), zero)).otherwise(let(F.regexp_replace(F.regexp_replace(x, r"^[()]+|[()]+$", ""), r"[' ]", ""), lambda t: _marked(x, t))))
    return amount if null_is_zero else F.when(raw.isNotNull(), amount)


def _marked(s: Column, t: Column) -> Column:
    """The amount of a text s with marks; t: without parentheses and quotes."""
    negative = s.startswith("(") & s.endswith(")")
    comma, dot = F.instr(F.reverse(t), ","), F.instr(F.reverse(t), ".")
    tail = F.substring_index(t, ",", -1)
    head = F.left(t, F.length(t) - F.length(tail) - 1)
    last = F.substring_index(t, ".", -1)
    number = (
        F.when((comma > 0) & (dot > 0), F.when(comma < dot, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit(""))))
        .when(comma > 0, F.when((F.length(tail) == 3) & (head != ""), F.concat(head, tail)).otherwise(F.concat(head, F.lit("."), tail)))
        .when(F.size(F.split(t, r"\.")) > 2, F.concat(F.replace(F.left(t, F.length(t) - F.length(last) - 1), F.lit("."), F.lit("")), F.lit("."), last))
        .otherwise(t)
    )
    value = F.regexp_replace(number, r"^\+", "").try_cast(AMOUNT)
    value = F.when(t.rlike(r"^[0-9.,+\-]+$"), F.coalesce(value, F.lit(0).cast(AMOUNT))).otherwise(F.lit(0).cast(AMOUNT))
    return F.when(negative, -value).otherwise(value).cast(AMOUNT)


def looks_like_amount(raw: Column) -> Column:
    """Digits, marks, signs and parentheses only, with a digit; dates and account numbers qualify too."""
    return F.coalesce(raw, F.lit("")).rlike(LIKE)


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit("0.01").cast("decimal(4,2)")
