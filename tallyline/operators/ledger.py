"""Accounts, totals, reconciliation, cross-checks and deduplication. All plans are declarative; one
shuffle by account each, with partial aggregation before it."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions import close

ZERO = F.lit


def zero() -> Column:
    return F.lit(0).cast("decimal(28,4)")


def account_totals(transactions: DataFrame, *keys: str) -> DataFrame:
    """AGG1-AGG3, AGG5: per account total_debit, total_credit, transaction_count, debit_count, credit_count, undated."""
    debit, credit = F.col("debit_amount"), F.col("credit_amount")
    undated = F.count_if(F.col("transaction_date").isNull()) if "transaction_date" in transactions.columns else F.lit(0).cast("long")
    return transactions.groupBy(*(keys or ("account_number",))).agg(
        F.coalesce(F.sum(debit), zero()).alias("total_debit"), F.coalesce(F.sum(credit), zero()).alias("total_credit"), F.count(F.lit(1)).alias("transaction_count"),
        F.count_if(debit != 0).alias("debit_count"), F.count_if(credit != 0).alias("credit_count"), undated.alias("undated"),
    )


def reconcile(totals: DataFrame, stated: DataFrame, *keys: str) -> DataFrame:
    """REC1-REC5. stated: keys, stated_debit, stated_credit, stated_count, stated_debit_count, stated_credit_count,
    opening_balance, closing_balance (null: not printed). Adds checks (turnover, count, balance: pass, fail or skipped), messages, passed, performed."""
    by = list(keys or ("account_number",))
    d, c = F.col("total_debit"), F.col("total_credit")
    sd, sc = F.col("stated_debit"), F.col("stated_credit")
    show = lambda x: x.cast("string")
    off = lambda a, b: b.isNotNull() & ~close(a, b)
    word = lambda bad: F.when(bad, "fail").otherwise("pass")
    split = F.col("stated_debit_count").isNotNull() & F.col("stated_credit_count").isNotNull()
    count_off = F.when(split, (F.col("debit_count") != F.col("stated_debit_count")) | (F.col("credit_count") != F.col("stated_credit_count"))).otherwise(F.col("transaction_count") != F.col("stated_count"))
    no_count = F.col("stated_count").isNull() & ~split
    no_turnover = sd.isNull() & sc.isNull()
    rolled = F.col("opening_balance") + c - d
    no_balance = F.col("opening_balance").isNull() | F.col("closing_balance").isNull()
    turnover = F.when(no_turnover, "skipped").otherwise(word(off(d, sd) | off(c, sc)))
    count = F.when(no_count, "skipped").otherwise(word(count_off))
    balance = F.when(no_balance, "skipped").otherwise(word(~close(rolled, F.col("closing_balance"))))
    out = totals.join(stated, by, "left").withColumn("checks", F.create_map(F.lit("turnover"), turnover, F.lit("count"), count, F.lit("balance"), balance))

    def differs(what, have, want):
        return F.when(off(have, want), F.concat(F.lit(f"{what} turnover: {{"), show(have), F.lit("} in rows, {"), show(want), F.lit("} stated")))

    messages = F.array_compact(
        F.array(
            F.when(no_turnover, F.lit("no turnover stated")), differs("debit", d, sd), differs("credit", c, sc),
            F.when(F.col("checks")["count"] == "fail", F.concat(F.lit("document count: "), show(F.col("transaction_count")), F.lit(" in rows, "), F.coalesce(show(F.col("stated_count")), F.concat_ws("+", show(F.col("stated_debit_count")), show(F.col("stated_credit_count")))), F.lit(" stated"))),
            F.when(F.col("checks")["balance"] == "fail", F.concat(F.lit("balance: rolls to "), show(rolled), F.lit(", stated "), show(F.col("closing_balance")))),
            F.when(no_turnover & no_count & no_balance, F.lit("nothing stated to verify against")),
        )
    )
    values = F.map_values("checks")
    return out.withColumns({"messages": messages, "passed": F.forall(values, lambda v: v != "fail"), "performed": F.exists(values, lambda v: v != "skipped")})


def active(accounts: DataFrame, transactions: DataFrame, key: str = "account_number") -> DataFrame:
    """PRD8: accounts with a transaction."""
    return accounts.join(transactions, key, "left_semi")


def cross_check(left: DataFrame, right: DataFrame, key: str = "account_number") -> DataFrame:
    """JON1, SET1: two extractions (key, transaction_count, total_debit, total_credit) side by side, with status: only_left, only_right, count, totals or same."""
    cols = ("transaction_count", "total_debit", "total_credit")
    side = lambda df, s: df.select(key, *(F.col(c).alias(f"{s}_{c}") for c in cols), F.lit(True).alias(s))
    both = side(left, "left").join(side(right, "right"), key, "full_outer")
    apart = ~close(F.col("left_total_debit"), F.col("right_total_debit")) | ~close(F.col("left_total_credit"), F.col("right_total_credit"))
    status = (
        F.when(F.col("right").isNull(), "only_left").when(F.col("left").isNull(), "only_right")
        .when(F.col("left_transaction_count") != F.col("right_transaction_count"), "count").when(apart, "totals").otherwise("same")
    )
    return both.withColumn("status", status).drop("left", "right")


def needs_fallback(checked: DataFrame, *by: str) -> DataFrame:
    """JON2: per file, whether the reference side has several active accounts and any disagrees."""
    several = F.count_if(F.col("right_transaction_count") > 0) > 1
    return checked.groupBy(*by).agg((several & F.bool_or(F.col("status") != "same")).alias("fallback"))


def dedup_accounts(accounts: DataFrame, file: str, order: str) -> DataFrame:
    """DED1: a later empty account whose number was seen before goes; blank numbers are never equal."""
    n = F.row_number().over(Window.partitionBy(file, "account_number").orderBy(order))
    return accounts.withColumn("n", n).where("n = 1 OR transaction_count > 0 OR account_number = ''").drop("n")


def dedup_rows(transactions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """DED2: the first of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return transactions.withColumn("n", n).where("n = 1").drop("n")


def first_match(candidates: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """CTL2, CTL3: the value that is first in scan order."""
    return candidates.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def best_total(candidates: DataFrame, keys: list[str], value: str, rank: str, order: str) -> DataFrame:
    """CTL4, ORD5: of the highest rank, the first in scan order."""
    return candidates.groupBy(*keys).agg(F.max_by(value, F.struct(F.col(rank), -F.col(order))).alias(value))


def flat(accounts: DataFrame, transactions: DataFrame, key: str = "account_number") -> DataFrame:
    """SNK8: one row a transaction, led by the client's account."""
    return accounts.select(F.col(key)).join(transactions, key).withColumnRenamed(key, "client_account")
