"""Tumbling aggregates on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.functions.readings import aggregate_measures, event_time
from tremora.schemas import AGGREGATE


def window_agg_stream(
    readings: DataFrame, size: str = "1 second", delay: str = "10 seconds", time: str = "event"
) -> DataFrame:
    """window_agg with a watermark, so the state of closed windows is dropped.

    ``time="event"`` windows by collect_timestamp and gives the batch result;
    ``time="processing"`` windows by arrival and cannot be repeated.
    """
    if time == "processing":
        timed = readings.withColumn("__time", F.current_timestamp()).withWatermark(
            "__time", "0 seconds"
        )
    elif "event_time" in readings.columns:  # set, with its watermark, by an operator upstream
        timed = readings.withColumnRenamed("event_time", "__time")
    else:
        timed = readings.withColumn("__time", event_time()).withWatermark("__time", delay)
    return (
        timed.groupBy("sensor_id", F.window("__time", size).alias("w"))
        .agg(*aggregate_measures())
        .withColumns(
            {
                "window_start_ts": F.unix_millis("w.start"),
                "window_end_ts": F.unix_millis("w.end"),
            }
        )
        .select(AGGREGATE.fieldNames())
    )
