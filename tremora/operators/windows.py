"""Tumbling aggregates per sensor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.functions.readings import aggregate_measures, window_start
from tremora.schemas import AGGREGATE

SECOND_MS = 1_000
DAY_MS = 86_400_000


def window_agg(readings: DataFrame, size_ms: int = SECOND_MS) -> DataFrame:
    """Mean, max, min and phase counts per sensor and half-open window [start, end).

    The key is (sensor, window start) and rows are combined before the exchange, so
    a sensor or window holding most rows costs one partial row per task.
    A window without readings gives no row.
    """
    keyed = readings.withColumn("window_start_ts", window_start("collect_timestamp", size_ms))
    return (
        keyed.groupBy("sensor_id", "window_start_ts")
        .agg(*aggregate_measures())
        .withColumn("window_end_ts", F.col("window_start_ts") + F.lit(size_ms))
        .select(AGGREGATE.fieldNames())
    )
