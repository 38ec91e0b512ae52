"""Converts statements from the command line: ``spark-submit -m`` style, or ``python -m tallyline FILES -o OUT``."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyline.engine import convert
from tallyline.operators import extraction, sinks


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tallyline", description="Converts bank statements to JSON and checks them against what they state.")
    p.add_argument("files", nargs="+", help="files, folders or patterns that Spark can read")
    p.add_argument("-o", "--output", help="folder for one JSON text a file")
    p.add_argument("--stdout", action="store_true", help="print payloads, a line a file")
    p.add_argument("--extended", action="store_true")
    p.add_argument("--include-empty", action="store_true")
    p.add_argument("--split", action="store_true", help="one text an account")
    p.add_argument("--name-style", choices=("composite", "clean"), default="composite")
    p.add_argument("--currency", default="UZS")
    p.add_argument("--engine", choices=("ai", "rules", "auto"), default="rules")
    p.add_argument("--extractor", help="module:function that asks the model (for ai and auto)")
    p.add_argument("--batch-rows", type=int, default=60)
    p.add_argument("--no-verify", action="store_true")
    p.add_argument("--report", action="store_true", help="reports beside the payloads")
    p.add_argument("--strict", action="store_true", help="exit 1 if a check fails")
    p.add_argument("-q", "--quiet", action="store_true")
    return p.parse_args(argv)


def options(a: argparse.Namespace) -> extraction.Options | None:
    if a.engine == "rules":
        return None
    if not a.extractor:
        if a.engine == "ai":
            raise SystemExit("--engine ai needs --extractor module:function")
        return None
    module, name = a.extractor.split(":")
    return extraction.Options(getattr(importlib.import_module(module), name), batch_rows=a.batch_rows, name_style=a.name_style, default_currency=a.currency, verify=not a.no_verify)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("tallyline").getOrCreate()
    mode = {"rules": "offline"}.get(a.engine, a.engine)
    c = convert(spark, a.files, mode, options(a), a.name_style, a.currency)
    payloads = c.payloads(a.extended, a.include_empty)
    if a.output and a.split:
        sinks.write_accounts(c.accounts if a.include_empty else c.accounts.where("transaction_count > 0"), c.transactions, f"{a.output}/accounts", a.extended)
    elif a.output:
        sinks.write_payloads(payloads, f"{a.output}/payloads")
    if a.output and a.report:
        sinks.write_payloads(c.reports(), f"{a.output}/reports")
    if a.stdout:
        for r in payloads.select(F.coalesce("payload", F.lit("[]")).alias("p")).toLocalIterator():
            print(r.p)
    if not a.quiet:
        for r in sinks.summary_text(c.files, c.accounts).toLocalIterator():
            print(r.line, file=sys.stderr)
    return sinks.exit_status(c.grid, c.accounts, a.strict)


if __name__ == "__main__":
    sys.exit(main())
