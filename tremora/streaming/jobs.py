"""The composed jobs on a stream, each as one query.

Append mode writes a window once the watermark has passed it. To see open windows as
well, write the aggregates with runner.changes_to_table and read runner.latest; the
two-stage form (deduplicated readings to a table, that table to aggregates) allows it
after deduplication too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tremora.operators.quality import filter_valid
from tremora.sinks.text import format_agg
from tremora.streaming.history import with_history_stream
from tremora.streaming.stateful import dedup_first_seen_stream, dedup_last_kept_stream
from tremora.streaming.windows import window_agg_stream


def filter_aggregate_stream(
    readings: DataFrame, size: str = "1 second", delay: str = "10 seconds", time: str = "event"
) -> DataFrame:
    return format_agg(window_agg_stream(filter_valid(readings), size, delay, time))


def first_seen_aggregate_stream(
    readings: DataFrame, size: str = "1 second", delay: str = "10 seconds", **thresholds: float
) -> DataFrame:
    kept = dedup_first_seen_stream(filter_valid(readings), delay=delay, **thresholds)
    return format_agg(window_agg_stream(kept, size))


def last_kept_aggregate_stream(
    readings: DataFrame, size: str = "1 second", delay: str = "10 seconds", **thresholds: float
) -> DataFrame:
    kept = dedup_last_kept_stream(filter_valid(readings), delay=delay, **thresholds)
    return format_agg(window_agg_stream(kept, size), with_noise=False)


def last_kept_history_stream(
    readings: DataFrame,
    size: str = "1 second",
    delay: str = "10 seconds",
    history: int = 10,
    **thresholds: float,
) -> DataFrame:
    """The whole sensor job as one query: deduplication, windows, and each finished window's
    history, deviation and line. Three stateful steps, each keyed by sensor."""
    kept = dedup_last_kept_stream(filter_valid(readings), delay=delay, **thresholds)
    scored = with_history_stream(window_agg_stream(kept, size), history)
    return format_agg(scored, with_noise=False)
