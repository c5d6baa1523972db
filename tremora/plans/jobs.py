"""The composed jobs: each takes readings (or payloads, or metrics) and returns its output."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tremora.functions.readings import window_start
from tremora.operators.chunks import PiecePlan
from tremora.operators.dedup import dedup_first_seen, dedup_last_kept
from tremora.operators.history import with_history
from tremora.operators.quality import filter_valid
from tremora.operators.scaling import PRODUCTION, Policy, alerts, recommend, retain
from tremora.operators.spatial import plan_blocks, score_spatial, spatial_anomaly
from tremora.operators.windows import SECOND_MS, window_agg
from tremora.session import stored
from tremora.sinks.text import format_agg, format_record
from tremora.sources.payloads import decode_payloads, split_decoded


def decode_lines(payloads: DataFrame) -> DataFrame:
    """Decode, leave the undecodable out, one line per reading."""
    good, _ = split_decoded(decode_payloads(payloads))
    return format_record(good)


def filter_aggregate(readings: DataFrame, size_ms: int = SECOND_MS) -> DataFrame:
    """Valid readings, aggregated per sensor and window, with a line each."""
    return format_agg(window_agg(filter_valid(readings), size_ms))


def first_seen_aggregate(
    readings: DataFrame, size_ms: int = SECOND_MS, **thresholds: float
) -> DataFrame:
    """As filter_aggregate, without near-duplicates of each sensor's first reading."""
    return format_agg(window_agg(dedup_first_seen(filter_valid(readings), **thresholds), size_ms))


def last_kept_aggregate(
    readings: DataFrame,
    size_ms: int = SECOND_MS,
    history: int = 10,
    plan: PiecePlan | None = None,
    history_plan: PiecePlan | None = None,
    **thresholds: float,
) -> DataFrame:
    """Deduplicated against the last kept reading, aggregated, compared with history."""
    kept = dedup_last_kept(filter_valid(readings), plan=plan, **thresholds)
    aggregates = window_agg(kept, size_ms)
    if history_plan:
        aggregates = stored(aggregates, "aggregates")
    scored = with_history(aggregates, history, history_plan)
    return format_agg(scored, with_noise=False)


def last_kept_spatial(
    readings: DataFrame,
    size: float,
    radius: int = 1,
    threshold: float = 0.5,
    plan: PiecePlan | None = None,
    block_plan: PiecePlan | None = None,
    **thresholds: float,
) -> DataFrame:
    """The spatial side of the same job: scores of kept readings among kept readings."""
    kept = dedup_last_kept(filter_valid(readings), plan=plan, **thresholds)
    if block_plan and not block_plan.is_whole:
        kept = stored(kept, "kept")
    scored = score_spatial(kept, size, radius, block_plan)
    return scored.withColumn("is_spatial_anomaly", spatial_anomaly(threshold))


def last_kept_job(
    readings: DataFrame,
    size: float,
    size_ms: int = SECOND_MS,
    history: int = 10,
    threshold: float = 0.5,
    plan: PiecePlan | None = None,
    **thresholds: float,
) -> DataFrame:
    """The whole job: readings are deduplicated and stored once; each kept reading then has its
    spatial score, its window's mean, and the window's history and deviation."""
    kept = stored(dedup_last_kept(filter_valid(readings), plan=plan, **thresholds), "kept")
    scored = score_spatial(kept, size, plan=plan_blocks(kept, size))
    windows = with_history(window_agg(kept, size_ms), history).select(
        "sensor_id", "window_start_ts", "avg_amplitude", "history_avg", "deviation"
    )
    in_window = scored.withColumns(
        {
            "window_start_ts": window_start("collect_timestamp", size_ms),
            "is_spatial_anomaly": spatial_anomaly(threshold),
        }
    )
    return in_window.join(windows, ["sensor_id", "window_start_ts"], "left")


def scaling_alerts(
    metrics: DataFrame, now: int, policy: Policy = PRODUCTION, **slicing: int
) -> DataFrame:
    """Recent metrics, debounced, turned into recommendations, one alert per change."""
    return alerts(recommend(retain(metrics, now), policy, **slicing))
