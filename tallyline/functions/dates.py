"""Dates and times. No time zones: values are TIMESTAMP_NTZ."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.texts import let

#: Accepted forms. Day first: a four-digit year with dots (any time), slashes (no time, or one with seconds)
#: or hyphens (no time); a two-digit year with dots (any time). Year first: with hyphens (any time) or dots (no time).
WHOLE = r"^(?:(\d{1,2})([./-])(\d{1,2})\2(\d{4}|\d{2})|(\d{4})([.-])(\d{1,2})\6(\d{1,2}))(?: (\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?$"
#: Year, month, day, hour, minute, second, separator (after a Y, where the year is first).
FIELDS = "$4$5|$3$7|$1$8|$9|$10|$11|$2Y$6"
#: The form of most dates; what every accepted form has in it.
COMMON = r"^\d\d\.\d\d\.\d{4}(?: \d\d:\d\d:\d\d)?\z"
NEAR = r"\d[./-]\d"
DATE, TIME = r"(?U)\b(\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4})\b", r"(?U)\b(\d{1,2}:\d{2}(?::\d{2})?)\b"


def _made(p: Column) -> Column:
    """The time of the fields of one match; null if they are none."""
    at = lambda i: F.get(p, F.lit(i))
    part = F.transform(F.slice(p, 1, 6), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    mark, short, clock, seconds = at(6), F.length(at(0)) == 2, at(3) != "", at(5) != ""
    fits = F.when(mark.isin(".Y", "Y-"), True).when(mark == "/Y", ~short & (~clock | seconds)).when(mark == "-Y", ~short & ~clock).otherwise(~clock)
    # Two-digit years from 69 on are of the last century.
    whole = lambda n: F.when(short, n[0] + F.when(n[0] >= 69, 1900).otherwise(2000)).otherwise(n[0])
    made = let(part, lambda n: F.try_make_timestamp_ntz(whole(n), n[1], n[2], n[3], n[4], n[5].cast("decimal(16,6)")))
    return F.when((F.size(p) == 7) & fits, made)


def parse_datetime(raw: Column) -> Column:
    """The whole text in one of FORMS; else its first date (with its first time, or alone). Null where nothing fits.
    Day numbers of spreadsheets are ``parse_serial``'s."""
    whole = lambda x: let(F.split(F.regexp_replace(x, WHOLE, FIELDS), r"\|"), _made)

    def within(x: Column) -> Column:
        date, time = F.regexp_extract(x, DATE, 1), F.regexp_extract(x, TIME, 1)
        both = F.struct(F.when((date != "") & (date != x), date).alias("alone"), time.alias("time"))
        return let(both, lambda d: F.coalesce(F.when((d["time"] != "") & d["alone"].isNotNull(), whole(F.concat_ws(" ", d["alone"], d["time"]))), F.when(d["alone"].isNotNull(), whole(d["alone"]))))

    s = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\s+", " "))
    return let(s, lambda x: F.when(x.rlike(NEAR), F.coalesce(F.when(x.rlike(COMMON), _common(x)).otherwise(whole(x)), within(x))))


def _common(x: Column) -> Column:
    """The time of a text of the form COMMON; the fields are at fixed places."""
    at = lambda i, n: F.coalesce(F.substring(x, i, n).try_cast("int"), F.lit(0))
    return F.try_make_timestamp_ntz(at(7, 4), at(4, 2), at(1, 2), at(12, 2), at(15, 2), at(18, 2).cast("decimal(16,6)"))


def looks_like_date(raw: Column) -> Column:
    return parse_datetime(raw).isNotNull()


def parse_serial(number: Column) -> Column:
    """A spreadsheet's day number as a timestamp; null outside [25000, 80000]."""
    micros = F.round(number * 86400 * 1_000_000).cast("long")
    return F.when(number.between(25000, 80000), F.timestamp_add("MICROSECOND", micros, F.lit("1899-12-30").cast("timestamp_ntz")))


def parse_time(raw: Column) -> Column:
    """Seconds of the day of the first H:MM[:SS]; null if there is none or it is no time."""

    def seconds(p: Column) -> Column:
        h, m, s = (F.get(p, F.lit(i)).try_cast("int") for i in range(3))
        s = F.coalesce(s, F.lit(0))
        return F.when((h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)

    return F.when(F.contains(raw, F.lit(":")), let(F.split(F.regexp_extract(raw, TIME, 1), ":"), seconds))


def combine(date: Column, seconds: Column) -> Column:
    """The day with another time; the same value where seconds is null."""
    return F.when(seconds.isNull(), date).otherwise(F.timestamp_add("SECOND", seconds, F.date_trunc("day", date).cast("timestamp_ntz")))


def format_datetime(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "dd.MM.yyyy HH:mm:ss"), F.lit(""))


def format_date(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "dd.MM.yyyy"), F.lit(""))
