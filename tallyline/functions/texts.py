"""Texts, labels and roles."""

import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.vocabulary import BANKS, MARKERS, ROLES

#: What a label loses first; what separates its words; Latin letters that look like Cyrillic ones.
DROPPED = "№#⁋§℮™©®"
BREAKS = r"[\s  -​.,:;!?()\[\]{}<>«»„“”\"'`’‘/\\|\-–—_*+=]+"
LATIN, CYRILLIC = "caeopxykmthb", "саеорхукмтнв"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value worked out once however often it is used: expressions in lambdas do not share their parts."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def clean_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def _compatible() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters that NFKC makes another letter, those letters, and the sequences that it changes in labels (ligatures, and marks behind Latin and Cyrillic letters)."""
    one, many = [], []
    for c in map(chr, [*range(0xA0, 0xD800), *range(0xF900, 0x10000)]):
        to = unicodedata.normalize("NFKC", c)
        if to != c and len(to) == 1:
            one.append((c, to))
        elif 0xFB00 <= ord(c) <= 0xFB06 or c == "…":
            many.append((c, to))
    for c in map(chr, [*range(0xC0, 0x180), *range(0x400, 0x500)]):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2:
            many.append((parts, c))
    return "".join(a for a, _ in one), "".join(b for _, b in one), many


#: Characters of which NFKC may make others.
COMPATIBLE = r"[\u00A0-\u00BE\u02B0-\u036F\u2000-\u33FF\uF900-\uFFFF]"
COMPAT_FROM, COMPAT_TO, COMPAT_PARTS = _compatible()


def quoted(text: str) -> str:
    """A text as a literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def constants(rows: Iterable[str] | Iterable[tuple[str, ...]], *names: str) -> Column:
    """An array of fixed texts, or of structs of them if there are names, as one expression: a Column for each word would cost a call of the JVM each."""
    struct = lambda r: "named_struct(" + ", ".join(f"'{n}', {quoted(v)}" for n, v in zip(names, r, strict=True)) + ")"
    return F.expr("array(" + ", ".join(struct(r) if names else quoted(r) for r in rows) + ")")


def compatible(text: Column) -> Column:
    """NFKC, as far as labels need it. Plain texts are left alone after one look."""
    parts = F.aggregate(constants(COMPAT_PARTS, "a", "b"), F.translate(text, COMPAT_FROM, COMPAT_TO), lambda s, p: F.replace(s, p["a"], p["b"]))
    return F.when(text.rlike(COMPATIBLE), parts).otherwise(text)


def normalize_label(text: Column) -> Column:
    """NFKC, lower case, separators as single blanks."""
    return F.trim(F.regexp_replace(F.lower(compatible(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{DROPPED}]", ""))), "(?U)" + BREAKS, " "))


def plain_label(text: str) -> str:
    """normalize_label for words of the vocabulary."""
    import re

    return re.sub(BREAKS, " ", unicodedata.normalize("NFKC", text.translate(dict.fromkeys(map(ord, DROPPED)))).lower()).strip()


def fold_homoglyphs(text: Column) -> Column:
    return F.translate(text, LATIN, CYRILLIC)


def _folded(words: Iterable[str]) -> list[str]:
    folded = (plain_label(w).translate(str.maketrans(LATIN, CYRILLIC)) for w in words)
    return list(dict.fromkeys(w for w in folded if w))


#: Folded words of the vocabulary with their roles, in order: those that a label equals, and those that it has as a part.
EXACT = [(w, r) for r, e, _ in ROLES for w in _folded(e)]
PARTS = [(w, r) for r, _, p in ROLES for w in _folded(p)]


def match_role(label: Column) -> Column:
    """The role of a column label, or null: exact labels of all roles in order, then parts of labels in order."""
    return F.get(F.transform(F.array(fold_homoglyphs(normalize_label(label))), role_of), F.lit(0))


def role_of(s: Column) -> Column:
    """match_role of a label that is normalized and folded already (a column or in a lambda, so that this happens once)."""
    exact = F.get(F.filter(constants(EXACT, "word", "role"), lambda w: w["word"] == s), F.lit(0))["role"]
    return F.when((s != "") & (F.length(s) <= 90), F.coalesce(exact, part_of(s)))


def part_of(s: Column) -> Column:
    """The role of the first word that is a part of a folded label."""
    return F.get(F.filter(constants(PARTS, "word", "role"), lambda w: F.contains(s, w["word"])), F.lit(0))["role"]


def _any(s: Column, words: list[str], test) -> Column:
    """Any word passes the test; the text is worked out once, and the words are one constant."""
    return F.exists(F.array(s), lambda x: F.exists(constants(words), lambda w: test(x, w)))


def markers(kind: str) -> list[str]:
    return [w for w in map(plain_label, MARKERS[kind]) if w]


def starts_with_any(normalized: Column, *kinds: str) -> Column:
    """A normalized text starts with a marker of one of these kinds."""
    return _any(normalized, [w for k in kinds for w in markers(k)], Column.startswith)


def has_marker(text: Column, kind: str) -> Column:
    return _any(normalize_label(text), markers(kind), Column.contains)


def starts_with_marker(text: Column, kind: str) -> Column:
    return _any(normalize_label(text), markers(kind), Column.startswith)


def detect_bank(text: Column) -> Column:
    s = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(_any(s, words, Column.contains), F.lit(bank)) for bank, words in BANKS], F.lit("unknown"))


def row_text(cells: Column) -> Column:
    """Non-empty cells joined by blanks; a cell equal to the one before it counts once."""
    return joined(F.transform(cells, clean_text))


def joined(clean: Column) -> Column:
    """row_text of cells that are cleaned already."""
    return let(F.filter(clean, lambda c: c != ""), lambda full: F.array_join(F.filter(full, lambda c, i: (i == 0) | (c != F.get(full, i - 1))), " "))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w.\-]+", "_"), "^_+|_+$", "")


def document_number(text: Column, numeric: Column) -> Column:
    """A number without a zero fraction, any other text cleaned; empty for null."""
    whole = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\.0+$", "")
    return F.when(F.coalesce(numeric, F.lit(False)), whole).otherwise(clean_text(text))
