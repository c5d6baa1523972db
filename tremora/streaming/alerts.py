"""Debounced scaling alerts on a stream of metrics samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tremora.operators.scaling import PRODUCTION, Policy, alerts, decide, policy_conditions, retain
from tremora.sources.metrics import parse_metrics
from tremora.streaming.stateful import stateful

EVENT_TIME = "sample_time"


class Debounce(StatefulProcessor):
    """The samples of a job's last ``duration`` seconds, each with the conditions it met.

    See operators.scaling.sustained. The samples leave the state with the next ones, or, if none
    come, by a timer once the watermark has passed their span.
    """

    def __init__(self, names: list[str], duration: int, min_samples: int):
        self.names, self.duration, self.min_samples = names, duration, min_samples

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "ts bigint, met bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("ts", kind="stable")
        met = np.zeros(len(frame), np.int64)
        for bit, name in enumerate(self.names):
            met |= frame[name].fillna(False).to_numpy(bool).astype(np.int64) << bit
        before = list(self.recent.get())
        ts = np.array([t for t, _ in before] + frame["ts"].tolist(), np.int64)
        bits = np.concatenate([np.array([m for _, m in before], np.int64), met])
        order = np.argsort(ts, kind="stable")
        ts, bits = ts[order], bits[order]
        own = frame["ts"].to_numpy(np.int64)
        first = np.searchsorted(ts, own - self.duration, side="left")
        last = np.searchsorted(ts, own, side="right")
        enough = last - first >= self.min_samples
        for bit, name in enumerate(self.names):
            failed = np.append(0, np.cumsum(bits >> bit & 1 == 0))
            frame[name] = enough & (failed[last] == failed[first])
        newest = int(ts[-1])
        keep = ts >= newest - self.duration
        self.recent.put(list(zip(ts[keep].tolist(), bits[keep].tolist())))
        self.handle.registerTimer((newest + self.duration + 1) * 1000)
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest = max((t for t, _ in self.recent.get()), default=None)
        # A timer that later samples have overtaken leaves them alone.
        if newest is not None and expiredTimerInfo.getExpiryTimeInMs() > (newest + self.duration) * 1000:
            self.recent.clear()
        return iter([])

    def close(self) -> None:
        pass


def sustained_stream(
    metrics: DataFrame,
    conditions: dict[str, Column],
    duration: int,
    min_samples: int = 3,
    by: str = "job_id",
    delay: str = "1 hour",
) -> DataFrame:
    """Stream form of sustained: one flag per condition, given as each sample arrives.

    A sample is judged by those that came before it or with it, so a job's samples should arrive
    in order of time, and those of one second together. Samples behind the watermark (``delay``
    after the newest) and samples without a time are left out.
    """
    flagged = metrics.withColumns({name: F.coalesce(c, F.lit(False)) for name, c in conditions.items()})
    timed = flagged.where("ts IS NOT NULL").withColumn(EVENT_TIME, F.timestamp_seconds("ts"))
    processor = Debounce(list(conditions), duration, min_samples)
    return stateful(
        timed.withWatermark(EVENT_TIME, delay), [by], processor, timed.schema, "EventTime", EVENT_TIME
    ).drop(EVENT_TIME)


def read_job_logs_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The samples of log files as they arrive, a folder ``job_id=...`` per job."""
    reader = spark.readStream.schema(T.StructType().add("value", "string").add("job_id", "string"))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_metrics(reader.text(path), F.col("job_id"))


def scaling_alerts_stream(
    metrics: DataFrame, now: int, policy: Policy = PRODUCTION, delay: str = "1 hour"
) -> DataFrame:
    """Stream form of plans.jobs.scaling_alerts: logs in, an alert per change asked for."""
    flagged = sustained_stream(
        retain(metrics, now), policy_conditions(policy), policy.duration, policy.min_samples, delay=delay
    )
    return alerts(decide(flagged, policy))
