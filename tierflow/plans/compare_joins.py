"""Seconds of each join strategy on a skewed key: `python -m tierflow.plans.compare_joins --help`."""

from __future__ import annotations

import argparse
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.operators.joins import STRATEGIES, strategy_join, strategy_session
from tierflow.session import open_session
from tierflow.sources import scratch, store


def skewed(spark: SparkSession, facts: int, dims: int, hot: float) -> tuple[DataFrame, DataFrame]:
    """Facts of which a share has key 0, and a dimension of 20 categories; the same under any partitioning."""
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1e6
    key = F.when(draw < hot, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("id", F.lit("key")), F.lit(dims)))
    left = spark.range(facts).select(key.alias("k"), (F.pmod("id", F.lit(10_000)) / 100).cast("decimal(18,2)").alias("amount"))
    right = spark.range(dims).select(F.col("id").alias("k"), F.concat(F.lit("c"), (F.col("id") % 20).cast("string")).alias("category"))
    return left, right


def compare(spark: SparkSession, *, facts: int = 20_000_000, dims: int = 2_000_000, hot: float = 0.3, salts: int = 32) -> dict[str, float]:
    """Each strategy runs in a session of its own settings; both inputs are written once and read by all."""
    folder = f"{scratch.root(spark)}/tierflow/joins-{uuid.uuid4().hex}"
    names, took = ("facts", "dims"), {}
    try:
        for name, df in zip(names, skewed(spark, facts, dims, hot)):
            df.write.parquet(f"{folder}/{name}")
        for name in STRATEGIES:
            own = strategy_session(spark, name)
            left, right = (own.read.parquet(f"{folder}/{n}") for n in names)
            began = time.time()
            strategy_join(left, right, "k", name, buckets=salts).groupBy("category").agg(F.sum("amount")).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 2)
    finally:
        store.remove(spark, folder)
    return took


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--facts", type=int, default=20_000_000)
    p.add_argument("--dims", type=int, default=2_000_000)
    p.add_argument("--hot", type=float, default=0.3)
    p.add_argument("--salts", type=int, default=32)
    a = p.parse_args(argv)
    spark = open_session("compare-joins", 64)
    print(json.dumps(compare(spark, facts=a.facts, dims=a.dims, hot=a.hot, salts=a.salts)))
    spark.stop()


if __name__ == "__main__":
    main()
