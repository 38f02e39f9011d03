"""Shared plumbing of the training-data operators: table reads, scratch tables, row keys.

Arrow batches are left to the session: Spark bounds them by bytes (spark.sql.execution.arrow.maxBytesPerBatch),
and no operator changes a setting of the caller's session. pieces() bounds what is made of a batch at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.sources import scratch

#: The most bytes that a table may have on its way to be broadcast, as its rows are counted and measured.
BROADCAST_BYTES = 32 << 20
#: What a task writes of a table that gathered() finds small.
FILE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """The application's own part of the shared folder."""
    return f"{scratch.root(spark)}/tierflow/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{scratch_folder(spark)}/{what}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all scratch tables of the application: for a job's end, when its results are written.

    Results are lazy and read scratch tables, so the operators can only delete those that no result needs.
    """
    drop_path(spark, scratch_folder(spark))


def pieces(batches: Iterable[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in pieces of about `size` bytes, so that what Python makes of them at once is bounded."""
    for b in batches:
        step = max(1, b.num_rows * size // max(b.nbytes, 1))
        for at in range(0, max(b.num_rows, 1), step):
            yield b.slice(at, step)


def settle(df: DataFrame, what: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def gathered(df: DataFrame, size: int) -> DataFrame:
    """`df`, dealt by an exchange, in a partition for each FILE_BYTES of `size`, the most bytes it may have, if it is small enough to be broadcast.

    Else as the session deals it. A small table in hundreds of files costs a task each, and on a local file system the
    executor's JVM starts processes for each (chmod).
    """
    return df.coalesce(size // FILE_BYTES + 1) if size <= BROADCAST_BYTES else df


def size_of(df: DataFrame) -> int:
    """Bytes of a settled table's files."""
    return path_bytes(df.sparkSession, df._settled_path)


def path_bytes(spark: SparkSession, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def is_few(df: DataFrame, limit: int | None = None) -> bool:
    """Whether a settled table's rows and bytes are few enough to be broadcast.

    Its files are compressed, so the bound is on their bytes (an eighth) and on its rows (32 bytes each).
    """
    limit = BROADCAST_BYTES if limit is None else limit
    return size_of(df) * 8 <= limit and df.limit(limit // 32 + 1).count() <= limit // 32


def few(df: DataFrame, limit: int | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """A settled table, or some columns of it, to be broadcast where its rows and bytes are found to be few; else as it is."""
    out = df.select(*columns) if columns else df
    return F.broadcast(out) if is_few(df, limit) else out


def marks(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of 2^25 bits of a column of 64-bit hashes, to be broadcast: 4 MB in 8,192 blocks, however many keys there are."""
    at = keys.select(*_slot(key))
    words = at.groupBy("block", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    by_word = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return settle(by_word.select("block", F.expr("transform(sequence(0, 63), w -> coalesce(m[w], 0L))").alias("bits")), "marks")


def marked(rows: DataFrame, bitmap: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows whose key may be one of marks() ("left_semi"), or the others ("left_anti"), without a shuffle of rows."""
    block, word, bit = _slot(key)
    there = F.getbit(F.get("bits", word), bit) == 1
    return rows.join(F.broadcast(bitmap.withColumnRenamed("block", "_block")), (F.col("_block") == block) & there, how)


def _slot(key: str) -> tuple[Column, Column, Column]:
    """Where a hash has its bit: 2^13 blocks of 64 words of 64 bits."""
    part = lambda shift, bits: F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    return part(0, 13).alias("block"), part(13, 6).alias("word"), part(19, 6).alias("bit")


def forget(*tables: DataFrame) -> None:
    """Delete tables made by settle() that nothing will read again."""
    for df in tables:
        drop_path(df.sparkSession, df._settled_path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """128 bits of a whole row, as two hashes; equal rows have equal keys, nulls and maps included."""
    cols = [_hashable(f) for f in df.schema.fields]
    null = F.concat(*(F.col(f"`{f.name}`").isNull().cast("string") for f in df.schema.fields))
    return F.xxhash64(null, *cols), F.xxhash64(*reversed(cols), F.lit("second"), null)


def _hashable(field) -> Column:
    c = F.col(f"`{field.name}`")
    return F.to_json(F.struct(c)) if "map<" in field.dataType.simpleString() else c
