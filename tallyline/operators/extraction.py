"""Statements read by a language model, then checked like parsed ones.

The model is an injected callable; nothing here opens a connection. A sheet is asked for its accounts with its first and
last rows; an account for its transactions in batches of rows. All else are joins, windows and projections: requests of
sheets and batches are independent rows, so they spread over the cluster as the model's side allows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegralType, StructType

from tallyline import functions as fn
from tallyline.operators import answers as sent
from tallyline.operators import ledger, rows

SHEET = ("file", "sheet")
ACCOUNT = (*SHEET, "section")
#: Rows shown from the top and from the bottom, letters of a cell, rows that a block may go on for.
HEAD, TAIL, LETTERS, BLOCK = 45, 15, 300, 3
COLUMNS = ("date", "document_number", "debit", "credit", "counterparty_account", "counterparty_name", "bank_code", "payment_purpose")
TEXTS = ("account_number", "currency", "account_name", "period_from", "period_to", "opening_balance", "closing_balance", "stated_debit_total", "stated_credit_total")
ACCOUNTS = "struct<accounts: array<struct<" + ", ".join(f"{t}: string" for t in TEXTS) + ", stated_count: int, header_row: int, first_data_row: int, last_data_row: int, layout: string, columns: struct<" + ", ".join(f"{c}: int" for c in COLUMNS) + ">>>>"
FIELDS = ("transaction_date", "document_number", "debit_amount", "credit_amount", "counterparty_name", "counterparty_account", "counterparty_inn", "bank_code", "payment_purpose")
TRANSACTIONS = "struct<transactions: array<struct<source_row: int, " + ", ".join(f"{f}: string" for f in FIELDS) + ">>>"


@dataclass(frozen=True)
class Options:
    """LLM1. ask(kind, body, most): kind is accounts or transactions, most a bound on the answer; gives (why it stopped, answer).

    It runs in tasks, so it must be importable there. An exception that it raises becomes the request's error.

    schema: ask gets the JSON schema of the answer as a fourth argument (``answer_schema``), for models that keep to one; it is then
    part of what makes two requests the same.

    answers: the folder of a table of answers, by which a request is sent once, also in another run (see ``answers``),
    and tried up to ``tries`` times; empty: requests are sent whenever their plan is worked out, and once each time.
    """

    ask: Callable[..., tuple[str, str]]
    batch_rows: int = 60
    most: int = 16_000
    most_for_accounts: int = 4_000
    name_style: str = "composite"
    default_currency: str = "UZS"
    verify: bool = True
    instructions: str = ""
    answers: str = ""
    tries: int = 3
    per_task: int = 4
    schema: bool = False


def rendered(row: Column, cells: Column) -> Column:
    """TXT12, ORD8: the row's number and its cells between tabs, without empty ones at the end; long cells are cut. Null for a blank row."""
    short = F.transform(F.transform(cells, fn.clean_text), lambda c: F.when(F.length(c) > LETTERS, F.concat(F.substring(c, 1, LETTERS), F.lit("…"))).otherwise(c))

    def line(x: Column) -> Column:
        last = F.array_max(F.transform(x, lambda c, i: F.when(c != "", i + 1)))
        return F.when(last.isNotNull(), F.concat(row.cast("string"), F.lit("\t"), F.array_join(F.slice(x, F.lit(1), last), "\t")))

    return F.get(F.transform(F.array(short), line), F.lit(0))


def decimal_or_none(text: Column) -> Column:
    """NUM4: null where the text is empty."""
    return F.when(fn.clean_text(text) != "", fn.parse_amount(fn.clean_text(text)))


def _json_schema(of: DataType) -> dict:
    """JSON schema of a Spark type: every field of an object is required, and there are no others."""
    if isinstance(of, StructType):
        return {"type": "object", "properties": {f.name: _json_schema(f.dataType) for f in of}, "required": of.fieldNames(), "additionalProperties": False}
    if isinstance(of, ArrayType):
        return {"type": "array", "items": _json_schema(of.elementType)}
    return {"type": "integer" if isinstance(of, IntegralType) else "string"}


def answer_schema(kind: str) -> dict:
    """LLM2: the JSON schema of the answers that ``read_answers`` reads, made from the same types; a layout is one of two words."""
    out = _json_schema(StructType.fromDDL("answer " + (ACCOUNTS if kind == "accounts" else TRANSACTIONS))["answer"].dataType)
    if kind == "accounts":
        out["properties"]["accounts"]["items"]["properties"]["layout"]["enum"] = ["row", "block"]
    return out


def _with_schema(ask: Callable[..., tuple[str, str]]) -> Callable[[str, str, int], tuple[str, str]]:
    schemas = {kind: answer_schema(kind) for kind in ("accounts", "transactions")}
    return lambda kind, body, most: ask(kind, body, most, schemas[kind])


def asked(requests: DataFrame, kind: str, most: int, o: Options) -> DataFrame:
    """LLM5: requests (any columns, body) with answer (text) and error: what the model or its transport said, cut off, refused, empty or not readable."""
    kept = [c for c in requests.columns if c not in ("answer", "error", "stopped")]
    ask = _with_schema(o.ask) if o.schema else o.ask
    if o.answers:
        what = F.concat_ws("\n", F.lit(json.dumps(answer_schema(kind))), "body") if o.schema else F.col("body")
        keyed = requests.select(*kept).withColumn("digest", sent.digest_of(kind, most, what))
        answered = sent.send(keyed.select("digest", "body"), ask, kind, most, o.answers, o.tries, o.per_task)
        return read_answers(keyed.join(answered, "digest", "left").drop("digest"), kind)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for body in f["body"]:
                try:
                    out.append((*ask(kind, body, most), None))
                except Exception as e:  # noqa: BLE001 - becomes the request's error
                    out.append((None, None, f"{type(e).__name__}: {e}"))
            f["stopped"], f["answer"], f["error"] = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [])
            yield f

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields if f.name in kept) + ", stopped string, answer string, error string"
    return read_answers(requests.select(*kept).mapInPandas(run, schema), kind)


def read_answers(told: DataFrame, kind: str) -> DataFrame:
    """Answers (stopped, answer, error) as ``found``, or why there is nothing in them as ``error``."""
    told = told.withColumn("read", F.from_json("answer", ACCOUNTS if kind == "accounts" else TRANSACTIONS))
    lists = F.col("read.accounts" if kind == "accounts" else "read.transactions")
    error = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("stopped") == "max_tokens", "the answer was cut off").when(F.col("stopped") == "refusal", "the model refused")
        .when(F.trim(F.coalesce("answer", F.lit(""))) == "", "the answer is empty").when(lists.isNull(), "the answer is not readable")
    )
    return told.withColumns({"error": error, "found": F.when(error.isNull(), lists)}).drop("stopped", "answer", "read")


def account_requests(grid: DataFrame, o: Options) -> DataFrame:
    """LLM2: file, sheet, n_rows, body: a sheet's first and last rows in one text."""
    g = grid.where("cells IS NOT NULL")
    of = Window.partitionBy(*SHEET)
    g = g.withColumns({"n_rows": F.max("row_idx").over(of) + 1, "n_cols": F.max(F.size("cells")).over(of)})
    start = F.greatest(F.lit(HEAD), F.col("n_rows") - TAIL)
    shown = g.where((F.col("row_idx") < HEAD) | (F.col("row_idx") >= start)).withColumn("line", rendered(F.col("row_idx"), F.col("cells")))
    part = lambda where: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(where & F.col("line").isNotNull(), F.struct("row_idx", "line")))), lambda x: x["line"]), "\n")
    s = shown.groupBy(*SHEET, "n_rows").agg(F.max("n_cols").alias("n_cols"), part(F.col("row_idx") < HEAD).alias("head"), part(F.col("row_idx") >= start).alias("tail"))
    size = F.concat(F.lit("Rows: "), F.col("n_rows").cast("string"), F.lit(", columns: "), F.col("n_cols").cast("string"))
    between = F.when(F.col("n_rows") > HEAD + TAIL, "Rows in between are transactions of the same shape.").otherwise("")
    return s.select(*SHEET, "n_rows", F.concat_ws("\n\n", size, F.concat(F.lit("First rows:\n"), F.col("head")), F.concat(F.lit("Last rows:\n"), F.col("tail")), F.nullif(between, F.lit("")), F.nullif(F.lit(o.instructions), F.lit(""))).alias("body"))


def accounts_of(told: DataFrame, o: Options) -> DataFrame:
    """The accounts that a sheet's answer names: file, sheet, section (from 1), their captions, stated figures, and where their rows are."""
    digits = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    a = told.select(*SHEET, "n_rows", F.posexplode("found").alias("section", "a")).withColumn("number", digits(F.col("a.account_number")))
    currency = F.coalesce(F.nullif(F.upper(fn.clean_text(F.col("a.currency"))), F.lit("")), fn.currency_from_account(F.col("number")), F.lit(o.default_currency))
    text = lambda n: fn.clean_text(F.col(f"a.{n}")).alias(n)
    stated = lambda n: decimal_or_none(F.col(f"a.{n}"))
    return a.select(
        *SHEET, (F.col("section") + 1).alias("section"), F.col("number").alias("account_number"), currency.alias("currency"), text("account_name"), text("period_from"), text("period_to"),
        stated("opening_balance").alias("opening_balance"), stated("closing_balance").alias("closing_balance"), stated("stated_debit_total").alias("stated_debit"), stated("stated_credit_total").alias("stated_credit"),
        F.nullif(F.col("a.stated_count"), F.lit(0)).cast("long").alias("stated_count"), F.coalesce("a.first_data_row", F.lit(0)).alias("first_row"), F.coalesce("a.last_data_row", F.col("n_rows") - 1).alias("last_row"),
        F.coalesce("a.layout", F.lit("row")).alias("layout"), F.to_json("a.columns").alias("mapping"),
    )


def data_rows(grid: DataFrame, accounts: DataFrame) -> DataFrame:
    """PRD11: the rows of each account, blank ones left out, with their text (line)."""
    g = grid.where("cells IS NOT NULL").select(*SHEET, "row_idx", rendered(F.col("row_idx"), F.col("cells")).alias("line")).where("line IS NOT NULL")
    return g.join(accounts.select(*ACCOUNT, "first_row", "last_row", "layout", "mapping", "account_number", "currency"), list(SHEET)).where("row_idx BETWEEN greatest(first_row, 0) AND last_row")


def transaction_requests(grid: DataFrame, accounts: DataFrame, o: Options) -> DataFrame:
    """LLM3, WIN8: one request for each batch of an account's rows; batches of blocks also show the rows that the last block may go on for."""
    r = rows.chunks(data_rows(grid, accounts), list(ACCOUNT), "row_idx", max(1, o.batch_rows))
    ends = r.groupBy(*ACCOUNT, "batch").agg(F.min("row_idx").alias("from_row"), F.max("row_idx").alias("to_row"))
    before = F.lag("to_row").over(Window.partitionBy(*ACCOUNT).orderBy("batch"))
    r = r.join(ends.withColumn("before", before), [*ACCOUNT, "batch"])
    goes_on = (F.col("layout") == "block") & (F.col("row_idx") <= F.col("before") + BLOCK)
    shown = r.withColumn("batch", F.explode(F.array_compact(F.array("batch", F.when(goes_on, F.col("batch") - 1)))))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "line"))), lambda x: x["line"]), "\n")
    b = shown.groupBy(*ACCOUNT, "batch", "account_number", "currency", "layout", "mapping").agg(text.alias("text")).join(ends, [*ACCOUNT, "batch"])
    lead = F.concat(F.lit("Account "), "account_number", F.lit(" ("), "currency", F.lit("), layout: "), "layout", F.lit("\nColumns, from 0 (-1: none): "), "mapping", F.lit("\nTransactions whose amount is in rows "), F.col("from_row").cast("string"), F.lit(" to "), F.col("to_row").cast("string"), F.lit("\n\n"))
    return b.select(*ACCOUNT, "batch", F.concat(lead, "text").alias("body"))


def transactions_of(told: DataFrame, o: Options) -> DataFrame:
    """LLM4, DED2: valid transactions of the answers, each source row once. Of two amounts the larger stays (equal: the debit)."""
    t = told.select(*ACCOUNT, "batch", F.posexplode("found").alias("place", "t")).select(*ACCOUNT, "batch", "place", "t.*")
    debit, credit = fn.parse_amount(F.col("debit_amount")), fn.parse_amount(F.col("credit_amount"))
    zero = ledger.zero()
    t = t.withColumns({"d": debit, "c": credit}).where("d <> 0 OR c <> 0")
    both = (F.col("d") != 0) & (F.col("c") != 0)
    digits = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\D", "")
    clean = lambda c: fn.clean_text(F.col(c))
    t = t.withColumns({"counterparty_account": digits("counterparty_account"), "counterparty_inn": digits("counterparty_inn"), "source_row": F.coalesce("source_row", F.lit(-1))})
    t = t.withColumns({
        "debit_amount": F.when(both & (F.col("d") < F.col("c")), zero).otherwise(F.col("d")), "credit_amount": F.when(both & (F.col("d") >= F.col("c")), zero).otherwise(F.col("c")),
        "transaction_date": fn.format_datetime(fn.parse_datetime(F.col("transaction_date"))), "document_number": clean("document_number"), "payment_purpose": clean("payment_purpose"),
        "counterparty_name": fn.compose_name(F.col("counterparty_account"), F.col("counterparty_inn"), clean("counterparty_name"), o.name_style), "bank_code": fn.pad_bank_code(F.col("bank_code")),
    })
    t = ledger.dedup_rows(t, [*ACCOUNT, "source_row"], ["batch", "place"])
    return t.select(*ACCOUNT, "transaction_date", "document_number", "credit_amount", "debit_amount", "counterparty_name", "counterparty_account", "bank_code", "payment_purpose", "counterparty_inn", F.lit("").alias("operation_code"), "source_row")


def extracted(grid: DataFrame, o: Options, keep=lambda d: d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """LLM6: (errors, accounts, transactions) of read_statements, reconciled like parsed ones. errors: file, sheet, section (null: the sheet itself), error.

    ``keep`` stores the answers, so that each request is sent once (a checkpoint or a written table).
    """
    sheets = keep(asked(account_requests(grid, o), "accounts", o.most_for_accounts, o))
    named = keep(accounts_of(sheets, o))
    told = keep(asked(transaction_requests(grid, named, o), "transactions", o.most, o))
    none = sheets.where("error IS NULL AND size(found) = 0").select(*SHEET, F.lit(None).cast("int").alias("section"), F.lit("the model found no account").alias("error"))
    errors = sheets.where("error IS NOT NULL").select(*SHEET, F.lit(None).cast("int").alias("section"), "error").union(none).union(told.where("error IS NOT NULL").select(*ACCOUNT, "error"))
    t = transactions_of(told, o)
    heads = named.drop("stated_debit", "stated_credit", "stated_count", "opening_balance", "closing_balance", "first_row", "last_row", "mapping")
    sums = ledger.account_totals(t.withColumn("transaction_date", F.nullif("transaction_date", F.lit(""))), *ACCOUNT)
    a = heads.join(sums, list(ACCOUNT), "left")
    a = a.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("transaction_count", "debit_count", "credit_count", "undated")} | {c: F.coalesce(c, ledger.zero()) for c in ("total_debit", "total_credit")})
    none = F.lit(None).cast("long")
    stated = named.select(*ACCOUNT, "stated_debit", "stated_credit", "stated_count", none.alias("stated_debit_count"), none.alias("stated_credit_count"), "opening_balance", "closing_balance")
    return errors, ledger.reconcile(a.withColumns({"warnings": F.array().cast("array<string>"), "client_inn": F.lit("")}), stated, *ACCOUNT), t


def compared(model: DataFrame, parsed: DataFrame) -> DataFrame:
    """LLM6, JON1: active accounts of both sides by file and number, with status (see ``ledger.cross_check``)."""
    side = lambda a: a.where("transaction_count > 0").groupBy(F.concat_ws("\t", "file", "account_number").alias("account_number")).agg(*[F.sum(c).alias(c) for c in ("transaction_count", "total_debit", "total_credit")])
    c = ledger.cross_check(side(model), side(parsed))
    return c.withColumns({"file": F.substring_index("account_number", "\t", 1), "account_number": F.substring_index("account_number", "\t", -1)})


def warnings(checked: DataFrame) -> DataFrame:
    """SET1: file, warnings: a line for each account that only one side has (by number), then for each that differs."""
    n = F.col("account_number")
    line = (
        F.when(F.col("status") == "only_right", F.struct(F.lit(0).alias("k"), n, F.concat(F.lit("account "), n, F.lit(": only parsed")).alias("w")))
        .when(F.col("status") == "only_left", F.struct(F.lit(1).alias("k"), n, F.concat(F.lit("account "), n, F.lit(": only from the model")).alias("w")))
        .when(F.col("status") != "same", F.struct(F.lit(2).alias("k"), n, F.concat(F.lit("account "), n, F.lit(": "), F.col("status"), F.lit(" differ")).alias("w")))
    )
    return checked.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["w"]).alias("warnings"))


def chosen(model: tuple[DataFrame, DataFrame], parsed: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """LLM6, JON2: (accounts, transactions): the model's, but the parsed ones of files where these have several active accounts and any differs."""
    back = ledger.needs_fallback(compared(model[0], parsed[0]), "file").where("fallback").select("file")
    return tuple(m.join(back, "file", "left_anti").unionByName(p.join(back, "file", "left_semi"), allowMissingColumns=True) for m, p in zip(model, parsed, strict=True))
