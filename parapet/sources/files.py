"""File readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from parapet.schemas import DATASET_COLUMNS


def read_messages(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None,
    line_breaks: bool = True, **options: str,
) -> DataFrame:
    """A labelled table from parquet, ORC, CSV, JSON or text files.

    CSV files are read with a header.  With ``line_breaks`` quoted values may hold
    line breaks, and a file is one task; without, large files are split.
    """
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", line_breaks).option("escape", '"')
    return reader.format(fmt).load(path)


def stream_messages(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
    files_per_trigger: int | None = None, glob: str | None = None,
) -> DataFrame:
    """The same files as a stream, in order of arrival."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def write_dataset(
    df: DataFrame, path: str, fmt: str = "csv", partition_by: list[str] | None = None,
    mode: str = "errorifexists",
) -> None:
    """The six dataset columns, or a metric table, as files."""
    columns = [c for c in DATASET_COLUMNS if c in df.columns]
    out = df.select(*columns) if len(columns) == len(DATASET_COLUMNS) else df
    writer = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        # texts are kept to the last blank
        writer = (
            writer.option("header", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_audit(audit: DataFrame, path: str, mode: str = "append") -> None:
    """Audit entries as JSON lines, one folder per attack type; times in UTC."""
    utc = F.to_utc_timestamp("ts", F.current_timezone())
    audit.withColumn(
        "ts", F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    ).write.mode(mode).partitionBy("attack_type").json(path)
