"""Joins on skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tierflow.functions.columns import row_hash

#: The part of the smaller heap that a right side's rows, as they are counted and measured, may take to be broadcast:
#: the driver holds them as collected, as a hash relation and in the blocks that it sends.
HEAP_PART = 16
#: Bytes of a row beside its texts and nested values: its place in the hash relation and in a page.
ROW_BYTES = 48

#: The strategies of strategy_join() and the settings that each has to run under.
STRATEGIES = {
    "merge": {"spark.sql.adaptive.enabled": "false"},
    "merge_adaptive": {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"},
    "salted": {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "false"},
    "broadcast": {"spark.sql.adaptive.enabled": "true"},
}
_NO_AUTO = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def strategy_session(spark: SparkSession, strategy: str) -> SparkSession:
    """A session beside the caller's, of the same application, with the strategy's settings: frames read in it run under them."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; one of {', '.join(STRATEGIES)}")
    own = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(k, spark.conf.get(k))
    for k, v in (STRATEGIES[strategy] | _NO_AUTO).items():
        own.conf.set(k, v)
    return own


def salted_join(left: DataFrame, right: DataFrame, key: str, buckets: int = 16, how: str = "inner") -> DataFrame:
    """An equi-join with the left key dealt over buckets and the right side repeated in each.

    The salt is a hash of the row and its place in its partition, not a random number: a task that is
    run again on the same rows deals alike. Only for joins that don't return right rows of their own:
    those would come once a bucket. It is merged, never broadcast: the planner takes the repeated right
    side to be as small as the table it is read from.
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"a salted join can't be {how}: unmatched right rows would repeat")
    # equal rows are numbered by their partition's order too, so copies of one row are dealt as well
    lot = F.xxhash64(row_hash(left), F.monotonically_increasing_id())
    dealt = left.withColumn("_salt", F.pmod(lot, F.lit(buckets)).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return dealt.join(spread.hint("merge"), [key, "_salt"], how).drop("_salt")


def broadcast_bytes(spark: SparkSession) -> int:
    """The most bytes of rows to be broadcast, by the heaps of the driver and the executors."""
    sc = spark.sparkContext
    heap = sc._jvm.java.lang.Runtime.getRuntime().maxMemory()
    if sc.master.split("[")[0] != "local":
        heap = min(heap, sc._jsc.sc().executorMemory() << 20)
    return heap // HEAP_PART


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    """Whether a frame's rows, each measured, are within the bytes that may be broadcast; nothing but two numbers reaches the driver."""
    limit = broadcast_bytes(df.sparkSession) if limit is None else limit
    fixed = ROW_BYTES + 16 * len(df.columns)
    if df.limit(limit // fixed + 1).count() > limit // fixed:
        return False
    rest = [f for f in df.schema.fields if not isinstance(f.dataType, NumericType)]
    sizes = (F.octet_length(F.col(f"`{f.name}`") if isinstance(f.dataType, StringType) else F.to_json(F.struct(F.col(f"`{f.name}`")))) for f in rest)
    own = sum((F.coalesce(s, F.lit(0)) for s in sizes), F.lit(fixed))
    return (df.agg(F.sum(own.cast("long"))).first()[0] or 0) <= limit


def strategy_join(left: DataFrame, right: DataFrame, key: str, strategy: str, *, buckets: int = 16) -> DataFrame:
    """An inner join by a named strategy, for comparing them: of frames of its strategy_session().

    A right side that is found to be too large for the driver and each executor to hold is merged instead of broadcast.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; one of {', '.join(STRATEGIES)}")
    if strategy == "salted":
        return salted_join(left, right, key, buckets)
    hint = "broadcast" if strategy == "broadcast" and fits_broadcast(right) else "merge"
    return left.join(right.hint(hint), key)
