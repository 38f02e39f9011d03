"""Behavioural features of transactions, from what happened before each one only.

The features are declared as data: RECENT over frames of the account's past seconds, OTHERS of the row
and its place. Frames run over whole seconds and end a second before the row, so neither the row nor
others of its second are seen. All windows lie inside an account, so its rows are exchanged once.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierflow.functions.columns import epoch_s

HOUR, DAY = 3600, 86_400
PASSED = ("txn_id", "account_id", "merchant_id", "txn_ts", "amount_gbp", "channel", "ingest_date")


class Recent(NamedTuple):
    """An aggregate over the seconds before a row: of how many (None: the look-back), and what is made of it."""

    name: str
    seconds: int | None
    of: Callable[[], Column]
    made: Callable[[Column], Column] = lambda c: c


def _ratio(mean: Column) -> Column:
    return F.round(F.try_divide(F.col("amount_gbp"), mean), 3)


RECENT = (
    Recent("txn_count_prev_1h", HOUR, lambda: F.count("_s")),
    Recent("txn_count_prev_24h", DAY, lambda: F.count("_s")),
    Recent("spend_prev_24h_gbp", DAY, lambda: F.sum("amount_gbp"), lambda c: F.coalesce(c, F.lit(0).cast("decimal(28,2)"))),
    Recent("avg_amount_prev_{days}d_gbp", None, lambda: F.avg("amount_gbp"), lambda c: F.round(c, 2)),
    Recent("amount_to_avg_ratio", None, lambda: F.avg("amount_gbp"), _ratio),
)


def behaviour(history: DataFrame, lookback_days: int = 30, *, home: str = "GBP", passed: tuple[str, ...] = PASSED) -> DataFrame:
    """Nine features for each row of history, transactions of every status; of a second's rows txn_id decides the order."""
    account = Window.partitionBy("account_id")
    frames = {n: account.orderBy("_s").rangeBetween(-(n or lookback_days * DAY), -1) for n in {r.seconds for r in RECENT}}
    made = {r.name.format(days=lookback_days): r.made(r.of().over(frames[r.seconds])) for r in RECENT}
    visit = F.struct("txn_ts", "txn_id")
    others = {
        "seconds_since_prev_txn": F.col("_s") - F.lag("_s").over(account.orderBy("_s", "txn_id")),
        # the first visit is the least one, whatever the order of the rows
        "is_first_txn_at_merchant": visit == F.min(visit).over(Window.partitionBy("account_id", "merchant_id")),
        "is_night_txn": F.hour(F.col("txn_ts").cast("timestamp")) < 6,
        "is_foreign_currency": F.col("currency") != home,
    }
    return history.withColumn("_s", epoch_s(F.col("txn_ts"))).select(*passed, *(c.alias(n) for n, c in (made | others).items()))
