"""Counterparties."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.accounts import find_account
from tallyline.functions.texts import clean_text, let

#: Fixed value: the tagged form.
TAGGED = r"(?isu)(?:МФО|МФ0|MFO|БИК|BIK)\s*[:\-]?\s*(\d*).*?(?:Счет|Счёт|Schet|Hisob)\s*[:\-]?\s*(\d*)(?:.*?(?:ИНН|INN|СТИР|STIR)\s*[:\-]?\s*(\d*))?"

#: What no tagged form is without (and what separates fields below).
TAG = r"(?iu)МФО|МФ0|MFO|БИК|BIK|\u0001"
#: A text that ends with nine digits; what separates the fields of one match.
ENDS, MARK = r"^(.*?)[ .,]*(\d{9})$", "\u0001"


def strip_trailing_inn(text: Column) -> Column:
    """struct(name, inn): nine digits at the end are an INN, peeled up to three times; the rightmost counts. Twelve digits or more are no INN."""

    def peeled(x: Column) -> Column:
        off = (x["last"] != "") & (x["rest"] != "") & ~x["name"].rlike(r"\d{12}$")
        inn = F.when(off & (x["inn"] == ""), x["last"]).otherwise(x["inn"])
        return F.struct(F.when(off, x["rest"]).otherwise(x["name"]).alias("name"), inn.alias("inn"))

    def once(have: Column, _: Column) -> Column:
        rest = F.regexp_replace(F.regexp_extract(have["name"], ENDS, 1), r"[ .,]+$", "")
        seen = F.struct(have["name"].alias("name"), have["inn"].alias("inn"), rest.alias("rest"), F.regexp_extract(have["name"], ENDS, 2).alias("last"))
        return F.get(F.transform(F.array(seen), peeled), F.lit(0))

    start = lambda x: F.struct(x.alias("name"), F.lit("").alias("inn"))
    trimmed = lambda x: F.struct(F.regexp_replace(x["name"], r"^[ .,]+|[ .,]+$", "").alias("name"), x["inn"].alias("inn"))
    ends = lambda x: x.rlike(r"\d{9}$") & ~x.rlike(r"\d{12}$")
    return let(clean_text(text), lambda x: F.when(ends(x), F.aggregate(F.sequence(F.lit(1), F.lit(3)), start(x), once, trimmed)).otherwise(trimmed(start(x))))


def parse_counterparty(blob: Column) -> Column:
    """struct(account, inn, name, bank_code, purpose) of a combined cell: tagged (in one line, or lines of tags, name, purpose), parts between slashes, or a name with INN."""
    none = F.struct(*(F.lit("").alias(n) for n in ("account", "inn", "name", "bank_code", "purpose")))
    return let(F.coalesce(blob, F.lit("")), lambda raw: F.when(raw == "", none).when(raw.rlike(TAG), _tagged(raw)).otherwise(let(clean_text(raw), _untagged)))


def _made(account, inn, name, bank, purpose=None):
    return F.struct(account.alias("account"), inn.alias("inn"), name.alias("name"), bank.alias("bank_code"), (F.lit("") if purpose is None else purpose).alias("purpose"))


def _tagged(raw: Column) -> Column:
    """parse_counterparty of a text that may be of the tagged form."""

    def tags(s):
        """Bank code, account, INN and what follows, by one match; a single element without one."""
        return F.split(F.regexp_replace(s, TAGGED.replace(")", ")^.*?", 1) + "(.*)$", MARK.join(("$1", "$2", "$3", "$4"))), MARK)

    tag = lambda t, i: F.get(t, F.lit(i))
    tagged = lambda t: (F.size(t) == 4) & ((tag(t, 0) != "") | (tag(t, 1) != ""))

    def chosen(x):
        lines, text, of_line, of_text = (x[n] for n in ("lines", "text", "of_line", "of_text"))
        many = _made(tag(of_line, 1), tag(of_line, 2), clean_text(F.get(lines, F.lit(1))), tag(of_line, 0), clean_text(F.array_join(F.slice(lines, 3, 10_000), " ")))
        after = F.regexp_replace(tag(of_text, 3), r"^[ /|\-]+|[ /|\-]+$", "")
        one = _made(tag(of_text, 1), tag(of_text, 2), after, tag(of_text, 0))
        return F.when((F.size(lines) > 1) & tagged(of_line), many).when(tagged(of_text), one).otherwise(let(text, _untagged))

    seen = F.struct(F.filter(F.transform(F.split(raw, "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines"), clean_text(raw).alias("text"))
    first = lambda x: F.coalesce(F.get(x["lines"], F.lit(0)), F.lit(""))
    return let(let(seen, lambda x: F.struct(x["lines"].alias("lines"), x["text"].alias("text"), tags(first(x)).alias("of_line"), tags(x["text"]).alias("of_text"))), chosen)


def _untagged(text: Column) -> Column:
    """The same for a cleaned text without tags."""
    empty = F.lit("")

    def of_parts(p: Column) -> Column:
        is_inn = F.coalesce(F.get(p, F.lit(1)), empty).rlike(r"^\d{7,12}$")
        slashed = F.when((F.size(p) >= 3) & is_inn, _made(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.array_join(F.slice(p, 3, 10_000), "/"), empty)).otherwise(_made(F.get(p, F.lit(0)), empty, F.array_join(F.slice(p, 2, 10_000), "/"), empty))
        return F.when((F.size(p) >= 2) & F.get(p, F.lit(0)).rlike(r"^\d{16,20}$"), slashed)

    plain = lambda x: _made(find_account(text), x["inn"], x["name"], empty)
    parts = F.when(F.contains(text, F.lit("/")), let(F.transform(F.split(text, "/"), lambda x: F.trim(x)), of_parts))
    return F.coalesce(parts, let(strip_trailing_inn(text), plain))


def compose_name(account: Column, inn: Column, name: Column, style: str = "composite") -> Column:
    """The parts that are not empty, joined by slashes; 'clean': the name alone."""
    return name if style == "clean" else F.concat_ws("/", *[F.nullif(c, F.lit("")) for c in (account, inn, name)])
