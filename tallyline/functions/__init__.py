"""Scalar functions of statements: Column in, Column out; no Python runs on executors."""

from tallyline.functions.accounts import currency_from_account, currency_from_text, find_account, pad_bank_code
from tallyline.functions.amounts import close, looks_like_amount, parse_amount
from tallyline.functions.counterparty import compose_name, parse_counterparty, strip_trailing_inn
from tallyline.functions.dates import combine, format_date, format_datetime, looks_like_date, parse_datetime, parse_serial, parse_time
from tallyline.functions.texts import clean_text, detect_bank, document_number, fold_homoglyphs, has_marker, match_role, normalize_label, part_of, role_of, row_text, safe_name, starts_with_any, starts_with_marker

__all__ = [n for n in dir() if not n.startswith("_")]
