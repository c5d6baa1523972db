"""Expressions over reading columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CRITICAL_AMPLITUDE = 50


def validity_rules() -> dict[str, Column]:
    """Each rule is true for an acceptable reading; bounds are inclusive.

    Plain comparisons on stored columns, so all five reach the parquet scan.
    """
    amplitude, lon, lat = F.col("seismic_amplitude"), F.col("longitude"), F.col("latitude")
    return {
        "quality": F.col("data_quality") == 1,
        "amplitude": (amplitude >= -100) & (amplitude <= 200),
        "sensor_id": F.col("sensor_id").isNotNull() & F.col("sensor_id").startswith("sensor_"),
        "longitude": (lon >= 73) & (lon <= 135),
        "latitude": (lat >= 3) & (lat <= 53),
    }


def violated(rule: Column) -> Column:
    """A rule that is false or cannot be decided counts as violated."""
    return ~F.coalesce(rule, F.lit(False))


def event_time() -> Column:
    return F.timestamp_millis("collect_timestamp")


def window_start(ts: str | Column, size_ms: int) -> Column:
    """Start of the tumbling window; also right for times before the epoch."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts - F.pmod(ts, F.lit(size_ms).cast("bigint"))


def aggregate_measures() -> list[Column]:
    """The measures of one window. Anything but P and S counts as noise."""
    amplitude, phase = F.col("seismic_amplitude"), F.col("phase_type")
    p, s = phase.eqNullSafe("P"), phase.eqNullSafe("S")
    return [
        F.avg(amplitude).alias("avg_amplitude"),
        F.max(amplitude).alias("max_amplitude"),
        F.min(amplitude).alias("min_amplitude"),
        F.count_if(p).alias("p_phase_count"),
        F.count_if(s).alias("s_phase_count"),
        F.count_if(~p & ~s).alias("n_phase_count"),
        F.count(F.lit(1)).alias("total_count"),
    ]
