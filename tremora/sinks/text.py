"""One-line text forms of readings and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.schemas import AGGREGATE

CSV_FIELDS = AGGREGATE.fieldNames()[:9]


def format_record(readings: DataFrame) -> DataFrame:
    return readings.withColumn(
        "line",
        F.format_string(
            "sensorId=%s | amplitude=%.2f | quality=%d",
            "sensor_id",
            "seismic_amplitude",
            "data_quality",
        ),
    )


def format_agg(aggregates: DataFrame, with_noise: bool = True) -> DataFrame:
    """The window as ``[start, end)``; ``with_noise=False`` leaves the last count out."""
    template = "sensorId=%s | window=[%d, %d) | avg=%.2f | max=%.2f | P=%d | S=%d"
    columns = [
        "sensor_id",
        "window_start_ts",
        "window_end_ts",
        "avg_amplitude",
        "max_amplitude",
        "p_phase_count",
        "s_phase_count",
    ]
    if with_noise:
        template, columns = template + " | N=%d", [*columns, "n_phase_count"]
    return aggregates.withColumn("line", F.format_string(template, *columns))


def agg_to_csv(aggregates: DataFrame) -> DataFrame:
    """The nine fields of an aggregate joined by commas, in column ``csv``."""
    return aggregates.withColumn(
        "csv", F.concat_ws(",", *[F.col(c).cast("string") for c in CSV_FIELDS])
    )
