"""Parquet tables by path: reading with a known schema, replacing partitions or the whole."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.delete(where, True)


def read(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The table, or None where there is none. With a schema a table without files is an empty one."""
    try:
        return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    except AnalysisException as e:
        if (e.getCondition() or "").split(".")[0] in _ABSENT:
            return None
        raise


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    found = read(spark, path, schema)
    return spark.createDataFrame([], schema) if found is None else found


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def overwrite(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replace the partitions that df has, or without partitions the whole table."""
    mode = "dynamic" if partition_by else "static"
    df.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*partition_by).parquet(path)


def put_partition(df: DataFrame, path: str, partition: Mapping[str, str]) -> None:
    """Make df (without the partition's columns) the whole content of one partition, also when df is empty.

    Dynamic overwriting leaves a partition alone that the new rows don't reach; a rerun that has none
    must still take the old ones away. df is written first and moved over, so it may read the old rows.
    """
    place = "/".join(f"{k}={v}" for k, v in partition.items())
    _put(df.drop(*partition), path, f"{path}/{place}")


def replace(df: DataFrame, path: str) -> None:
    """Replace a table by rows that may come from itself."""
    _put(df, path, path)


def _put(df: DataFrame, table: str, target: str) -> None:
    """Write df beside the table, put what is there aside, move df over, and only then remove the old rows.

    The staging folder is the writer's own, so writers of different partitions don't meet; a writer that
    stops between the moves leaves the old rows beside the table, where the next one puts them back first.
    """
    spark, own = df.sparkSession, uuid.uuid4().hex
    staged, aside = f"{table}__staging-{own}", f"{table}__aside{target.removeprefix(table).replace('/', '-').replace('=', '-')}"
    fs, to = _fs(spark, target)
    old = _fs(spark, aside)[1]
    if fs.exists(old) and not fs.exists(to):
        fs.rename(old, to)
    try:
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(staged)
        fs.delete(old, True)
        fs.mkdirs(to.getParent())
        fs.mkdirs(old.getParent())
        if fs.exists(to) and not fs.rename(to, old):
            raise OSError(f"{target} can't be put aside")
        if not fs.rename(_fs(spark, staged)[1], to):
            fs.rename(old, to)
            raise OSError(f"{staged} can't be moved to {target}")
    finally:
        remove(spark, staged)
    fs.delete(old, True)


def partition(df: DataFrame, day: str) -> DataFrame:
    return df.where(F.col("ingest_date") == day)


def latest_snapshot(df: DataFrame, day: str) -> DataFrame:
    """Rows of the last ingest_date up to day, pruned to its partition; none if there is no such date."""
    last = df.where(F.col("ingest_date") <= day).agg(F.max("ingest_date")).first()[0]
    return df.where(F.lit(False)) if last is None else partition(df, last)
