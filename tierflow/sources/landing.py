"""Landing files: explicit schema, permissive parsing, bad lines told from good."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierflow.spec import PipelineSpec

CORRUPT = "_corrupt_record"
LINEAGE = {"_ingest_ts": "timestamp", "_source_file": "string", "_batch_id": "string"}


def read_day(spark: SparkSession, spec: PipelineSpec, source: str, day: str) -> DataFrame | None:
    """One day's delivery of a source with its file's name, or None where there is no folder for it."""
    own = spec.source(source)
    reader = spark.read.format(own.format).schema(own.schema).options(**own.options)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    try:
        return reader.load(f"{spec.path('landing', source)}/ingest_date={day}").select("*", F.col("_metadata.file_path").alias("_source_file"))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def with_lineage(df: DataFrame, batch_id: str) -> DataFrame:
    return df.withColumns({"_ingest_ts": F.current_timestamp(), "_batch_id": F.lit(batch_id)})


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good without the marker, bad): df should be cached, a raw file can't be asked for its bad lines alone."""
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT), df.where(F.col(CORRUPT).isNotNull())


def parse_lines(lines: DataFrame, value: str, schema: str, fmt: str, options: dict[str, str] | None = None) -> DataFrame:
    """Parse text that is already in a column as the file readers would; other columns stay."""
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **(options or {})}
    parse = F.from_json if fmt == "json" else F.from_csv
    parsed: Column = parse(F.col(value), schema, how) if fmt == "csv" else parse(F.col(value), T.StructType.fromDDL(schema), how)
    return lines.withColumn("_row", parsed).select(*[c for c in lines.columns if c != value], "_row.*")
