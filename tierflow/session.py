"""Session settings, applied to a new session or to one that the caller already has."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# What every run relies on. Partition columns stay strings, a partitioned overwrite
# replaces only the partitions it writes, and times are UTC.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "snappy",
}


def open_session(app: str, shuffle_partitions: int = 64, master: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.shuffle.partitions", shuffle_partitions)
    builder = builder.config("spark.driver.memory", os.environ.get("TIERFLOW_DRIVER_MEMORY", "4g"))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (builder.master(master) if master else builder).getOrCreate()


def adopt(spark: SparkSession) -> SparkSession:
    """Give a session that was made elsewhere the settings that file layers need."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
