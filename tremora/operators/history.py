"""Each window's aggregate against the windows before it.

History counts existing windows, not elapsed time: a sensor that was silent for a day
still compares with its last ten windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.functions.readings import window_start
from tremora.operators.chunks import PiecePlan, over_recent_rows

KEY, ORDER = ["sensor_id"], ["window_start_ts"]


def with_history(aggregates: DataFrame, n: int = 10, plan: PiecePlan | None = None) -> DataFrame:
    """Add history_avg, history_max and deviation over the ``n`` windows before each one.

    history_avg is NULL and the other two are 0 where there is no earlier window.
    ``plan`` cuts long sensor histories into pieces (see chunks.calendar_pieces).
    """

    def columns(window: Window) -> dict[str, Column]:
        frame = window.rowsBetween(-n, -1)
        return {
            "history_avg": F.avg("avg_amplitude").over(frame),
            "history_max": F.max("max_amplitude").over(frame),
        }

    scored = over_recent_rows(
        aggregates, KEY, ORDER, n, columns, ["avg_amplitude", "max_amplitude"], plan
    )
    average = F.col("history_avg")
    return scored.withColumns(
        {
            "history_max": F.coalesce("history_max", F.lit(0.0).cast("float")),
            "deviation": F.when(
                average > 0, (F.col("avg_amplitude") - average) / average
            ).otherwise(F.lit(0.0)),
        }
    )


def with_step_deviation(aggregates: DataFrame, plan: PiecePlan | None = None) -> DataFrame:
    """Add |mean - previous mean| / |previous mean|; 0 if that is 0, NULL on the first window."""

    def columns(window: Window) -> dict[str, Column]:
        return {"previous_avg": F.lag("avg_amplitude").over(window)}

    scored = over_recent_rows(aggregates, KEY, ORDER, 1, columns, ["avg_amplitude"], plan)
    previous = F.col("previous_avg")
    return scored.withColumn(
        "step_deviation",
        F.when(previous == 0, F.lit(0.0)).when(
            previous.isNotNull(), F.abs(F.col("avg_amplitude") - previous) / F.abs(previous)
        ),
    )


def last_windows(aggregates: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` windows of each sensor; age_rank 1 is the newest.

    The rank filter lets Spark keep n rows per sensor in each task before the exchange.
    """
    newest = Window.partitionBy(*KEY).orderBy(F.desc(ORDER[0]))
    return aggregates.withColumn("age_rank", F.row_number().over(newest)).where(
        F.col("age_rank") <= n
    )


def score_temporal(readings: DataFrame, history: DataFrame, size_ms: int) -> DataFrame:
    """Add history_avg of a reading's own window and temporal_ratio = amplitude / history_avg.

    The ratio is 1 where there is no history or it is 0. The join key holds the window
    as well as the sensor; adaptive execution splits what is still skewed.
    """
    baseline = history.select("sensor_id", "window_start_ts", "history_avg")
    average = F.col("history_avg")
    return (
        readings.withColumn("window_start_ts", window_start("collect_timestamp", size_ms))
        .join(baseline, ["sensor_id", "window_start_ts"], "left")
        .withColumn(
            "temporal_ratio",
            F.when(average.isNull() | (average == 0), F.lit(1.0)).otherwise(
                F.col("seismic_amplitude").cast("double") / average
            ),
        )
    )


def temporal_anomaly(threshold: float = 0.5) -> Column:
    """The ratio lies further than ``threshold`` from 1, on either side."""
    ratio = F.col("temporal_ratio")
    return (ratio > 1 + threshold) | (ratio < 1 - threshold)


def history_coverage(scored: DataFrame) -> DataFrame:
    """One row: windows, windows with and without history, and the share with."""
    known = F.col("history_avg").isNotNull()
    return scored.agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(known).alias("hits"),
        F.count_if(~known).alias("misses"),
        F.try_divide(F.count_if(known), F.count(F.lit(1))).alias("hit_rate"),
    )
