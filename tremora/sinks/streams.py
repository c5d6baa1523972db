"""Stream writers: console, rolling CSV files, memory. Parquet is in streaming.runner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def to_console(stream: DataFrame, mode: str = "append") -> DataStreamWriter:
    return stream.writeStream.format("console").outputMode(mode).option("truncate", "false")


def to_csv_files(
    aggregates: DataFrame,
    path: str,
    checkpoint: str,
    every: str | None = "30 seconds",
    max_records: int = 10_000,
) -> DataStreamWriter:
    """CSV files that roll with each trigger and after ``max_records`` rows.

    About 100 bytes a row: the default rolls near 1 MB. ``every=None`` drains the source.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        aggregates.writeStream.format("csv")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .option("maxRecordsPerFile", max_records)
        .trigger(**trigger)
    )


def to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataStreamWriter:
    """A table in the driver's memory: for tests and small outputs only."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode)
