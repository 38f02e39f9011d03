"""Daily aggregates of published transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def _of(channel: str, amount: Column) -> Column:
    """Sum over one channel; 0 where there is none."""
    return F.sum(F.when(F.col("channel") == channel, amount).otherwise(F.lit(0).cast(MONEY)))


def customer_daily(txns: DataFrame, accounts: DataFrame) -> DataFrame:
    """Spend by customer and event date, of transactions whose account is known.

    accounts(account_id, customer_id); whether it is broadcast is left to its size.
    """
    amount = F.col("amount_gbp")
    owned = txns.join(accounts.select("account_id", "customer_id"), "account_id")
    return owned.groupBy("customer_id", F.date_format("txn_ts", "yyyy-MM-dd").alias("txn_date")).agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.sum(amount).alias("total_spend_gbp"),
        F.round(F.avg(amount), 2).cast(MONEY).alias("avg_txn_gbp"),
        F.max(amount).alias("max_txn_gbp"),
        _of("ATM", amount).alias("atm_withdrawal_gbp"),
        _of("ONLINE", amount).alias("online_spend_gbp"),
        F.count_distinct("merchant_id").alias("distinct_merchants"),
    )


def category_daily(txns: DataFrame, merchants: DataFrame, *, exact: bool = False) -> DataFrame:
    """Spend by merchant category and event date; UNKNOWN where the merchant or its category is.

    Accounts are counted approximately (a sketch that merges) unless exact.
    """
    placed = txns.join(merchants.select("merchant_id", "merchant_category"), "merchant_id", "left").fillna("UNKNOWN", ["merchant_category"])
    accounts = F.count_distinct("account_id") if exact else F.approx_count_distinct("account_id")
    return placed.groupBy("merchant_category", F.date_format("txn_ts", "yyyy-MM-dd").alias("txn_date")).agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.sum("amount_gbp").alias("total_spend_gbp"),
        accounts.alias("approx_unique_accounts"),
    )


def touched_dates(txns: DataFrame, run_date: str) -> DataFrame:
    """(event_date): event dates that the batch of run_date has transactions on."""
    return txns.where(F.col("ingest_date") == run_date).select(F.col("txn_ts").cast("date").alias("event_date")).distinct()


def touched(txns: DataFrame, run_date: str, *, backfill: bool = True) -> DataFrame:
    """Completed transactions on the event dates that a batch touched.

    A semi-join, so the dates stay in the plan; event dates can't lie after the day they come in, so
    earlier batches than the first touched date are pruned by the caller's bound on ingest_date.
    With backfill all later batches count too, so a rerun of an old day loses no late rows; without,
    only those up to run_date.
    """
    dates = touched_dates(txns, run_date)
    rows = txns.where("status = 'COMPLETED'")
    if not backfill:
        rows = rows.where(F.col("ingest_date") <= run_date)
    return rows.withColumn("_day", F.col("txn_ts").cast("date")).join(dates, F.col("_day") == F.col("event_date"), "left_semi").drop("_day")
