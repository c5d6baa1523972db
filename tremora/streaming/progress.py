"""The progress of streams as a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("query_name", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("ended_at", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("input_records", T.LongType()),
        T.StructField("input_per_second", T.DoubleType()),
        T.StructField("processed_per_second", T.DoubleType()),
        T.StructField("late_records", T.LongType()),
        T.StructField("state_rows", T.LongType()),
        T.StructField("stages", T.MapType(T.StringType(), T.LongType())),
    ]
)


class ProgressLog(StreamingQueryListener):
    """Appends one row per micro-batch to a folder, so that no batch is forgotten.

    A row is a small file of its own, named by run and batch: a progress told twice is written
    once. It is written by the driver when the micro-batch has ended, with no Spark job. Add it with
    ``spark.streams.addListener``; ``compacted`` joins the files of stopped streams.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not p.numInputRows and not any(s.numRowsDroppedByWatermark for s in p.stateOperators):
            return  # a batch that only moved timers or the watermark
        row = {
            "query_id": str(p.id),
            "run_id": str(p.runId),
            "query_name": p.name,
            "batch_id": p.batchId,
            "ended_at": p.timestamp,
            "duration_ms": p.batchDuration,
            "input_records": p.numInputRows,
            "input_per_second": _finite(p.inputRowsPerSecond),
            "processed_per_second": _finite(p.processedRowsPerSecond),
            "late_records": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
            "state_rows": sum(s.numRowsTotal for s in p.stateOperators),
            "stages": {name: values["records"] for name, values in (p.observedMetrics or {}).items()},
        }
        self._write(f"{self.path}/{p.runId}-{p.batchId}.json", json.dumps(row) + "\n")

    def _write(self, name: str, text: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(name)
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def _finite(value: float | None) -> float | None:
    return value if value is not None and abs(value) < float("inf") and value == value else None


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS).json(path)


def stage_totals(progress: DataFrame) -> DataFrame:
    """Per query and observed stage: records over all its micro-batches, and their rate while it worked.

    A batch that ran again after a restart counts with its last run.
    """
    once = progress.groupBy("query_id", "batch_id").agg(
        F.max_by(F.struct("stages", "duration_ms", "input_records"), "ended_at").alias("b")
    )
    inputs = F.map_concat(F.create_map(F.lit("input"), F.col("b.input_records")), F.coalesce("b.stages", F.create_map().cast("map<string,bigint>")))
    rows = once.select("query_id", "b.duration_ms", F.explode(inputs).alias("stage", "n"))
    totals = rows.groupBy("query_id", "stage").agg(
        F.sum("n").alias("records"), F.sum("duration_ms").alias("duration_ms"), F.count(F.lit(1)).alias("batches")
    )
    return totals.withColumn("per_second", F.try_divide(F.col("records") * 1000.0, F.col("duration_ms")))
