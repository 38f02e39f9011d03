"""Duplicates inside a batch and replays across batches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierflow.functions.columns import row_hash


def _no_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, surplus): the first row of each key in the given order; rows with a null key are all kept.

    A digest of the whole row breaks ties, so both halves agree whenever they are computed. Rows with
    a null key branch off before the window, so the bare rank test prunes inside each task.
    """
    tie = row_hash(df)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by, tie))
    ranked = df.where(_no_null(keys)).withColumn("_rank", rank)
    kept = ranked.where("_rank = 1").drop("_rank").unionByName(df.where(~_no_null(keys)))
    return kept, ranked.where("_rank > 1").drop("_rank")


def without_replays(batch: DataFrame, published: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(fresh, replayed): rows whose key isn't, or is, among the published ones."""
    seen = published.select(*keys)
    return batch.join(seen, list(keys), "left_anti"), batch.join(seen, list(keys), "left_semi")
