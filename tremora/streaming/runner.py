"""Running streams to tables: position, triggers and whole results."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tremora.session import ROCKSDB_PROVIDER


@contextmanager
def stream_settings(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """RocksDB state in ``partitions`` parts, as many as the cluster has cores by default.

    Both are fixed by a query's first start; a restart takes them from its checkpoint. So give
    the number that the stream will need later if it first starts on a small cluster.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
        "spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism),
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def append_to_table(
    stream: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Append rows to parquet files, exactly once over restarts.

    Without ``every`` the query takes what is there and stops.
    """
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def changes_to_table(
    stream: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Write the rows that each micro-batch changed (update mode).

    A window shows up as soon as it has readings instead of when the watermark passes
    it, so nothing is held back at the end. A repeated batch overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**trigger)
        .start()
    )


def latest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The current rows of a table written by changes_to_table."""
    values = [c for c in changes.columns if c not in (*keys, "batch_id")]
    return changes.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in values])


def read_changes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    batch = T.StructField("batch_id", T.LongType())
    return spark.read.schema(T.StructType([*schema.fields, batch])).parquet(path)


def observe_stage(df: DataFrame, stage: str | Observation) -> DataFrame:
    """Count the rows that pass here while the job runs.

    With a name, a stream reports it under observedMetrics of its progress. For watching
    a job: rows of a task that had to run again are counted again. Use
    operators.quality.stage_counts for exact numbers.
    """
    return df.observe(stage, F.count(F.lit(1)).alias("records"))


def throughput(query: StreamingQuery) -> dict[str, float]:
    """Rows and rates of the last micro-batch, and the counts of its observed stages."""
    progress = query.lastProgress
    if progress is None:
        return {}
    stages = {
        f"{name}_records": row["records"] for name, row in (progress.observedMetrics or {}).items()
    }
    return {
        "input_records": progress.numInputRows,
        "input_per_second": progress.inputRowsPerSecond,
        "processed_per_second": progress.processedRowsPerSecond,
        **stages,
    }


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were left out, in the batches still on record.

    The query keeps the last ones only; progress.ProgressLog keeps all.
    """
    return sum(
        state.numRowsDroppedByWatermark
        for progress in query.recentProgress
        for state in progress.stateOperators
    )
