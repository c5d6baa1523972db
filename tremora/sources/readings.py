"""Reading tables in and out of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tremora.schemas import PAYLOAD, READING, READING_ORDER


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(READING).parquet(path)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOAD).parquet(path)


def read_stream(
    spark: SparkSession,
    path: str,
    max_files: int | None = None,
    schema: T.StructType = READING,
) -> DataFrame:
    """Files as a stream with a fixed schema, read in parallel.

    The position is kept by the query's checkpoint. ``max_files`` bounds one micro-batch.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def read_bounded(readings: DataFrame, n: int = 1000) -> DataFrame:
    """The first ``n`` readings in time order (a top-n, not a sort of everything)."""
    return readings.orderBy(*READING_ORDER).limit(n)
