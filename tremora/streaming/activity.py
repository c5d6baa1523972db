"""When sensors fall silent and return, on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tremora.functions.readings import event_time
from tremora.streaming.stateful import TS, stateful

CHANGES = T.StructType(
    [
        T.StructField("sensor_id", T.StringType()),
        T.StructField("since", T.LongType()),
        T.StructField("is_active", T.BooleanType()),
        T.StructField("last_seen", T.LongType()),
    ]
)


class Activity(StatefulProcessor):
    """The time of a sensor's last reading, and whether its silence has been told."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last bigint, silent boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, silent = self.seen.get() or (None, True)
        changes = []
        for ts in sorted({int(t) for frame in rows for t in frame[TS].tolist()}):
            if last is not None and ts <= last and not silent:
                continue  # came late, and changes nothing
            if last is not None and not silent and ts - last > self.ttl_ms:
                changes.append((key[0], last + self.ttl_ms + 1, False, last))
                silent = True
            if silent:
                changes.append((key[0], ts, True, ts))
                silent = False
            last = ts if last is None else max(last, ts)
        self.seen.update((last, silent))
        self.handle.registerTimer(last + self.ttl_ms + 1)
        yield pd.DataFrame(changes, columns=CHANGES.fieldNames())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, silent = self.seen.get() or (None, True)
        # Timers of earlier readings come too; only the one after the last reading tells silence.
        if not silent and expiredTimerInfo.getExpiryTimeInMs() > last + self.ttl_ms:
            self.seen.update((last, True))
            rows = [(key[0], last + self.ttl_ms + 1, False, last)]
            yield pd.DataFrame(rows, columns=CHANGES.fieldNames())

    def close(self) -> None:
        pass


def activity_stream(readings: DataFrame, ttl_ms: int, delay: str = "10 seconds") -> DataFrame:
    """A row when a sensor is first seen or returns, and one when it has been silent for ``ttl_ms``.

    Silence is told when the watermark passes it, so also if no reading of the sensor follows.
    Readings should arrive in order of time within ``delay``; later ones are left out.
    """
    timed = readings.select("sensor_id", TS).withColumn("event_time", event_time())
    timed = timed.withWatermark("event_time", delay)
    return stateful(timed, ["sensor_id"], Activity(ttl_ms), CHANGES, "EventTime")


def active_at(changes: DataFrame, as_of: int) -> DataFrame:
    """sensor_id of the sensors that were active at ``as_of``, from a table of changes."""
    newest = Window.partitionBy("sensor_id").orderBy(F.desc("since"), F.asc("is_active"))
    known = changes.where(F.col("since") <= as_of).withColumn("__rank", F.row_number().over(newest))
    return known.where("__rank = 1 AND is_active").select("sensor_id")
