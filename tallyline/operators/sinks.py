"""Results as JSON: columns first, text last. Lists are in the order of the source.

``files``, ``accounts`` and ``transactions`` are what ``operators.statements.statements`` returns. Amounts are exact JSON
numbers, without a fraction where there is none. One exchange by section nests transactions, one by file nests accounts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import safe_name
from tallyline.operators.statements import SECTION

BASE = ("transaction_date", "document_number", "credit_amount", "debit_amount", "counterparty_name", "counterparty_account", "bank_code", "payment_purpose")
MORE = ("counterparty_inn", "operation_code")


def amount(c: Column) -> Column:
    """SNK1: 300.0000 as 300, 116999945.4000 as 116999945.4; null stays null."""
    s = c.cast("decimal(28,4)").cast("string")
    return F.parse_json(F.regexp_replace(s, r"\.?0+$", ""))


def as_json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def transaction(extended: bool = False) -> Column:
    """SNK2"""
    shown = lambda n: amount(F.col(n)) if n.endswith("_amount") else F.col(n)
    return F.struct(*(shown(n).alias(n) for n in BASE + (MORE if extended else ())))


def reconciliation() -> Column:
    a = lambda n, to: amount(F.col(n)).alias(to)
    count = F.coalesce("stated_count", F.col("stated_debit_count") + F.col("stated_credit_count")).alias("count")
    return F.struct(
        F.when(F.col("passed"), "pass").otherwise("fail").alias("status"), "checks", "messages",
        F.struct(a("stated_debit", "debit"), a("stated_credit", "credit"), count, a("opening_balance", "opening_balance"), a("closing_balance", "closing_balance")).alias("stated"),
        F.struct(a("total_debit", "debit"), a("total_credit", "credit"), F.col("transaction_count").alias("count")).alias("computed"),
    )


def with_list(head: Column, name: str, items: Column) -> Column:
    """A JSON object's text with one more field, a list of JSON texts. Objects inside keep the order of their fields, which a variant would not."""
    return F.concat(F.left(head, F.length(head) - 1), F.lit(f',"{name}":'), items, F.lit("}"))


def nested(accounts: DataFrame, transactions: DataFrame, extended: bool = False) -> DataFrame:
    """SNK3: accounts with ``account``, the JSON text that holds their transactions."""
    t = transactions.groupBy(*SECTION).agg(F.transform(F.sort_array(F.collect_list(F.struct("source_row", as_json(transaction(extended)).alias("t")))), lambda x: x["t"]).alias("transactions"))
    a = accounts.join(t, list(SECTION), "left")
    first = ["account_number", "account_name", "client_inn", "currency", "period_from", "period_to", amount(F.col("opening_balance")).alias("opening_balance"), amount(F.col("closing_balance")).alias("closing_balance")] if extended else ["account_number", "currency"]
    head = F.struct(*first, "transaction_count", amount(F.col("total_credit")).alias("total_credit"), amount(F.col("total_debit")).alias("total_debit"))
    return a.withColumn("account", with_list(as_json(head), "transactions", _array("transactions")))


def _by_file(accounts: DataFrame, **lists: Column) -> DataFrame:
    """Per file, arrays of JSON texts in the order of sections, and account counts."""
    cols = [F.transform(F.sort_array(F.collect_list(F.struct("sheet", "section", c.alias("j")))), lambda x: x["j"]).alias(n) for n, c in lists.items()]
    return accounts.groupBy("file").agg(*cols, F.count(F.lit(1)).alias("n"), F.count_if(F.col("transaction_count") > 0).alias("n_active"), F.bool_and("passed").alias("all_passed"))


def _array(c: str) -> Column:
    return F.concat(F.lit("["), F.array_join(F.coalesce(c, F.array().cast("array<string>")), ","), F.lit("]"))


def payloads(files: DataFrame, accounts: DataFrame, transactions: DataFrame, extended: bool = False) -> DataFrame:
    """SNK4: file, payload: the account where there is just one, else a list."""
    a = _by_file(nested(accounts, transactions, extended), items=F.col("account"))
    return files.select("file").join(a, "file", "left").select("file", F.when(F.col("n") == 1, F.get("items", F.lit(0))).otherwise(_array("items")).alias("payload"))


def reports(files: DataFrame, accounts: DataFrame) -> DataFrame:
    """SNK6: file, report."""
    period = F.regexp_replace(F.concat_ws(" - ", "period_from", "period_to"), r"^[ \-]+|[ \-]+$", "")
    row = F.struct("account_number", "currency", "account_name", period.alias("period"), "transaction_count", amount(F.col("total_debit")).alias("total_debit"), amount(F.col("total_credit")).alias("total_credit"), reconciliation().alias("reconciliation"), "warnings")
    j = files.join(_by_file(accounts, items=as_json(row)), "file", "left")
    head = F.struct(F.col("file").alias("source_file"), "bank", "layout", F.coalesce("n", F.lit(0)).alias("account_count"), F.coalesce("n_active", F.lit(0)).alias("active_account_count"), "warnings")
    return j.select("file", with_list(as_json(head), "accounts", _array("items")).alias("report"))


def api_payloads(files: DataFrame, accounts: DataFrame, transactions: DataFrame, extended: bool = False, include_empty: bool = False) -> DataFrame:
    """SNK7: file, payload: accounts with transactions (or all), their checks, and whether all passed (none: pass)."""
    shown = nested(accounts if include_empty else accounts.where("transaction_count > 0"), transactions, extended)
    checked = F.struct("account_number", *(reconciliation()[n].alias(n) for n in ("status", "checks", "messages", "stated", "computed")))
    j = files.join(_by_file(shown, items=F.col("account"), checked=as_json(checked)), "file", "left")
    status = F.when(F.coalesce("all_passed", F.lit(True)), "pass").otherwise("fail").alias("status")
    common = as_json(F.struct(F.col("file").alias("source_file"), "bank", "layout", F.coalesce("n", F.lit(0)).alias("account_count"), "warnings"))
    checks = with_list(as_json(F.struct(status)), "accounts", _array("checked"))
    head = with_list(common, "reconciliation", checks)
    one = with_list(head, "account", F.get("items", F.lit(0)))
    return j.select("file", with_list(F.when(F.col("n") == 1, one).otherwise(head), "accounts", _array("items")).alias("payload"))


def flat_payloads(files: DataFrame, accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """SNK8, SET3: file, payload: transactions led by the client's account, and the warnings of the file and its active accounts, each once."""
    active = accounts.where("transaction_count > 0")
    t = transactions.join(active.select(*SECTION, F.col("account_number").alias("client_account")), list(SECTION))
    row = as_json(F.struct("client_account", *(transaction()[n].alias(n) for n in BASE)))
    t = t.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("sheet", "section", "source_row", row.alias("j")))), lambda x: x["j"]).alias("items"))
    w = active.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("sheet", "section", F.col("warnings").alias("w")))), lambda x: x["w"])).alias("more"))
    j = files.join(w, "file", "left").join(t, "file", "left")
    warnings = F.array_union("warnings", F.coalesce("more", F.array().cast("array<string>"))).alias("warnings")
    head = as_json(F.struct(F.col("file").alias("source_file"), "bank", "layout", F.coalesce("n", F.lit(0)).alias("client_account_count"), warnings))
    return j.select("file", with_list(head, "transactions", _array("items")).alias("payload"))


def summary(accounts: DataFrame) -> DataFrame:
    """SNK9: a line per account (not for empty ones of which nothing was stated), checks by name, and ``ok``."""
    marks = F.array_join(F.transform(F.array_sort(F.map_entries("checks")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return accounts.where("transaction_count > 0 OR coalesce(stated_count, 0) <> 0").select("file", "sheet", "section", "account_number", "currency", "transaction_count", "total_debit", "total_credit", marks.alias("checks"), F.col("passed").alias("ok"))


def summary_text(files: DataFrame, accounts: DataFrame) -> DataFrame:
    """SNK9 as text: file, place, line: a heading for each file with its warnings, then its accounts with what did not pass."""
    two = lambda c: F.lpad(F.format_number(F.col(c), 2), 20, " ")
    a = accounts.where("transaction_count > 0 OR coalesce(stated_count, 0) <> 0")
    number = F.rpad(F.coalesce(F.nullif("account_number", F.lit("")), F.lit("(unknown account)")), 22, " ")
    marks = F.array_join(F.transform(F.array_sort(F.map_entries("checks")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    line = F.concat(F.lit("  "), number, F.lit(" "), "currency", F.lit("  "), F.lpad(F.col("transaction_count").cast("string"), 5, " "), F.lit("  debit "), two("total_debit"), F.lit("  credit "), two("total_credit"), F.lit("   "), marks)
    said = F.when(~F.col("passed"), F.transform("messages", lambda m: F.concat(F.lit("      ! "), m))).otherwise(F.array().cast("array<string>"))
    noted = F.concat(F.array(line), said, F.transform("warnings", lambda w: F.concat(F.lit("      ~ "), w)))
    a = a.select("file", F.struct("sheet", "section").alias("of"), F.posexplode(noted).alias("i", "line"))
    n = accounts.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("transaction_count") > 0).alias("active"))
    head = F.concat(F.regexp_extract("file", r"([^/\\]*)$", 1), F.lit("  [bank="), "bank", F.lit(", layout="), F.coalesce(F.nullif("layout", F.lit("")), F.lit("n/a")), F.lit(", "), F.coalesce("active", F.lit(0)).cast("string"), F.lit("/"), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" accounts active]"))
    f = files.join(n, "file", "left").select("file", F.struct(F.lit(-1).alias("sheet"), F.lit(0).cast("long").alias("section")).alias("of"), F.posexplode(F.concat(F.array(head), F.transform("warnings", lambda w: F.concat(F.lit("  ! "), w)))).alias("i", "line"))
    a = a.withColumn("of", F.struct(F.col("of.sheet").alias("sheet"), F.col("of.section").cast("long").alias("section")))
    return f.union(a).select("file", F.struct("of.sheet", "of.section", "i").alias("place"), "line").orderBy("file", "place")


def exit_status(grid: DataFrame, accounts: DataFrame, strict: bool = False) -> int:
    """SNK10: 2 if a file failed; else 1 if strict and an account shown did not pass; else 0. Two aggregated rows reach the driver."""
    if grid.agg(F.coalesce(F.bool_or(F.col("error").isNotNull()), F.lit(False))).head()[0]:
        return 2
    return int(strict and not summary(accounts).agg(F.coalesce(F.bool_and("ok"), F.lit(True))).head()[0])


def _stem() -> Column:
    """The file's own name, led by a digest of its folder, so that files of one name in several folders stay apart."""
    folder, name = F.regexp_extract("file", r"^(.*?)[^/\\]*$", 1), safe_name(F.regexp_extract("file", r"([^/\\]*)$", 1))
    return F.when(folder == "", name).otherwise(F.concat(name, F.lit("-"), F.substring(F.sha2(folder, 256), 1, 8)))


def write_payloads(payloads: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK5: one folder ``stem=<name>`` per file, with the payload as text. mode is Spark's; nothing is overwritten unless it says so."""
    payloads.select(_stem().alias("stem"), F.col(payloads.columns[1]).alias("value")).repartition("stem").write.mode(mode).partitionBy("stem").text(path)


def write_accounts(accounts: DataFrame, transactions: DataFrame, path: str, extended: bool = False, mode: str = "errorifexists") -> None:
    """SNK5, split: one folder per file and account (without a number: its section)."""
    a = nested(accounts, transactions, extended)
    number = F.coalesce(F.nullif(safe_name(F.col("account_number")), F.lit("")), F.concat_ws("-", "sheet", "section"))
    a.select(_stem().alias("stem"), number.alias("account"), F.col("account").alias("value")).repartition("stem", "account").write.mode(mode).partitionBy("stem", "account").text(path)
