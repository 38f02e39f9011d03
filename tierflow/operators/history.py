"""Type-2 history of a changing dimension, as one full join that sorts every key into an action."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIONS = ("insert", "update", "stale", "same", "untouched")


@dataclass
class History:
    """The new dimension and what became of each key (lazy); counts() runs one small job."""

    dimension: DataFrame
    actions: DataFrame

    def counts(self) -> dict[str, int]:
        found = {r["action"]: r["n"] for r in self.actions.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {a: found.get(a, 0) for a in ACTIONS}


def open_versions(changes: DataFrame, key: str, change_ts: str, batch_id: str) -> DataFrame:
    """Current versions from changes: valid from the change on, without an end."""
    return changes.withColumns(
        {
            "customer_sk": F.xxhash64(F.col(key), F.col(change_ts)),
            "effective_from": F.col(change_ts),
            "effective_to": F.lit(None).cast("timestamp"),
            "is_current": F.lit(True),
            "_batch_id": F.lit(batch_id),
        }
    )


def apply_changes(dimension: DataFrame | None, changes: DataFrame, *, key: str, change_ts: str, batch_id: str) -> History:
    """Fold changes (one row a key at most, with row_hash) into the dimension.

    new key: a version opens. Other hash and later than the current version: that one closes at the
    change, a new one opens. Other hash but not later: stale, ignored. Same hash: nothing, however
    late. Closed versions pass through. The interval of a version is [from, to).
    """
    fresh = open_versions(changes, key, change_ts, batch_id)
    if dimension is None:
        return History(fresh, fresh.select(key, F.lit("insert").alias("action")))
    columns = dimension.columns
    if lost := sorted(set(columns) ^ set(fresh.columns)):
        raise ValueError(f"the dimension and the changes differ in columns: {', '.join(lost)}")
    old = dimension.where("is_current").select(F.struct(*columns).alias("old"), F.col(key).alias("_old_key"))
    new = fresh.select(F.struct(*columns).alias("new"), F.col(key).alias("_new_key"))
    action = (
        F.when(F.col("new").isNull(), "untouched")
        .when(F.col("old").isNull(), "insert")
        .when(F.col("old.row_hash").eqNullSafe(F.col("new.row_hash")), "same")
        .when(F.col("new.effective_from") > F.col("old.effective_from"), "update")
        .otherwise("stale")
    )
    met = old.join(new, F.col("_old_key") == F.col("_new_key"), "full_outer").withColumn("action", action)
    closed = F.col("old").withField("effective_to", F.col("new.effective_from")).withField("is_current", F.lit(False))
    rows = (
        F.when(F.col("action") == "insert", F.array("new"))
        .when(F.col("action") == "update", F.array(closed, F.col("new")))
        .otherwise(F.array("old"))
    )
    current = met.select(F.explode(rows).alias("row")).select("row.*")
    past = dimension.where("not is_current")
    return History(past.unionByName(current.select(*columns)), met.select(F.coalesce("_new_key", "_old_key").alias(key), "action"))
