"""Per-key state on streams: deduplication and running neighbourhood means.

Within a micro-batch a key's readings are put in (collect_timestamp, event_id) order.
Across micro-batches they are taken as they come, so files should arrive in time order.
A handler holds one key's rows of one micro-batch, which the source's maxFilesPerTrigger
bounds; the state itself is a few numbers per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tremora.functions.grid import DEFAULT_CELL
from tremora.functions.readings import event_time
from tremora.operators.dedup import close_amplitude
from tremora.operators.spatial import BLOCK, BLOCK_CELLS, CELL, HOME, running_means, sent_to_blocks
from tremora.schemas import READING_ORDER

TS, ID = READING_ORDER
STATISTICS = T.StructType(
    [
        T.StructField("sensor_id", T.StringType()),
        T.StructField("input_count", T.LongType()),
        T.StructField("output_count", T.LongType()),
        T.StructField("skipped_count", T.LongType()),
    ]
)


def in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values([TS, ID], kind="stable")


class LastKept(StatefulProcessor):
    """Drops readings close to the last kept one; see operators.dedup.flag_last_kept.

    With event time, a baseline is removed once the watermark has passed its end: no reading
    that still counts could meet it.
    """

    def __init__(self, amplitude_threshold: float, gap_ms: int, ttl_ms: int, timed: bool = False):
        self.limits = (amplitude_threshold, gap_ms, ttl_ms)
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.baseline = handle.getValueState("baseline", "amp double, ts bigint, created bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        threshold, gap_ms, ttl_ms = self.limits
        near = close_amplitude(threshold)
        amp, ts, created = self.baseline.get() or (None, None, None)
        frame = in_order(rows)
        kept = []
        for t, a in zip(frame[TS].tolist(), frame["seismic_amplitude"].tolist()):
            if created is None or t - created > ttl_ms:
                created, keep = t, True
            else:
                keep = not (t - ts < gap_ms and near(a, amp))
            if keep:
                amp, ts = a, t
            kept.append(keep)
        self.baseline.update((amp, ts, created))
        if self.timed:
            self.handle.registerTimer(created + ttl_ms + 1)
        yield frame[kept]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.baseline.get()
        # A timer of an earlier baseline leaves the present one alone.
        if state and expiredTimerInfo.getExpiryTimeInMs() > state[2] + self.limits[2]:
            self.baseline.clear()
        return iter([])

    def close(self) -> None:
        pass


class LastKeptStatistics(LastKept):
    """Counts what LastKept lets pass and drops; emits a sensor's running counts per micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counts = handle.getValueState("counts", "seen bigint, kept bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        kept = sum(len(frame) for frame in super().handleInputRows(key, iter(frames), timerValues))
        seen, before = self.counts.get() or (0, 0)
        seen, kept = seen + sum(map(len, frames)), before + kept
        self.counts.update((seen, kept))
        yield pd.DataFrame([(key[0], seen, kept, seen - kept)], columns=STATISTICS.fieldNames())


class FirstSeen(StatefulProcessor):
    """Drops readings close to the sensor's first one; see operators.dedup.flag_first_seen."""

    def __init__(self, amplitude_threshold: float, gap_ms: int):
        self.amplitude_threshold = amplitude_threshold
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "amp float, ts bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = in_order(rows)
        first = self.first.get()
        fresh = first is None
        if fresh:
            first = (float(frame["seismic_amplitude"].iloc[0]), int(frame[TS].iloc[0]))
            self.first.update(first)
        amp, ts = first
        change = (frame["seismic_amplitude"] - pd.Series(amp, frame.index, "float32")).abs()
        near = (change.astype("float64") < self.amplitude_threshold) & (
            (frame[TS] - ts).abs() < self.gap_ms
        )
        if fresh:
            near.iloc[0] = False
        yield frame[~near]

    def close(self) -> None:
        pass


class BlockMeans(StatefulProcessor):
    """Running sums and counts of a block's cells; emits the block's own readings."""

    def __init__(self, columns: list[str], radius: int):
        self.columns, self.radius = columns, radius

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getValueState("cells", "n array<bigint>, total array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, total = self.cells.get() or ([0] * BLOCK_CELLS**2, [0.0] * BLOCK_CELLS**2)
        frame = in_order(rows)
        home = frame["in_block"].to_numpy(bool)
        means, total, n = running_means(
            frame["gx"].to_numpy() - key[0] * BLOCK_CELLS,
            frame["gy"].to_numpy() - key[1] * BLOCK_CELLS,
            np.zeros(len(frame), np.int64),
            frame["amount"].to_numpy(float),
            np.ones(len(frame)),
            np.zeros(len(frame), bool),
            home,
            np.array(total, float),
            np.array(n, float),
            self.radius,
        )
        self.cells.update((n.astype(int).tolist(), total.tolist()))
        scored = frame.loc[home, self.columns]
        yield scored.assign(neighbourhood_avg=means)

    def close(self) -> None:
        pass


def dedup_last_kept_stream(
    readings: DataFrame,
    amplitude_threshold: float = 0.5,
    gap_ms: int = 100,
    ttl_ms: int = 60_000,
    delay: str | None = None,
) -> DataFrame:
    """Stream form of dedup_last_kept.

    With ``delay`` the output carries ``event_time`` under a watermark, so that
    window_agg_stream can follow in the same query.
    """
    processor = LastKept(amplitude_threshold, gap_ms, ttl_ms, timed=delay is not None)
    return _per_sensor(readings, processor, delay)


def dedup_stats_stream(
    readings: DataFrame, amplitude_threshold: float = 0.5, gap_ms: int = 100, ttl_ms: int = 60_000
) -> DataFrame:
    """Running statistics of dedup_last_kept_stream: a row per sensor and micro-batch.

    Counts are totals since the stream's start, over restarts too; the newest row of a sensor
    holds. Write them with tables.changes_to_compacted_table and add shares with with_shares.
    """
    return stateful(readings, ["sensor_id"], LastKeptStatistics(amplitude_threshold, gap_ms, ttl_ms), STATISTICS)


def dedup_first_seen_stream(
    readings: DataFrame,
    amplitude_threshold: float = 0.01,
    gap_ms: int = 500,
    delay: str | None = None,
) -> DataFrame:
    """Stream form of dedup_first_seen: the first reading to arrive is the baseline.

    ``delay`` as in dedup_last_kept_stream.
    """
    return _per_sensor(readings, FirstSeen(amplitude_threshold, gap_ms), delay)


def score_spatial_stream(
    readings: DataFrame, size: float = DEFAULT_CELL, radius: int = 1
) -> DataFrame:
    """Stream form of score_spatial: readings travel to blocks of 8 x 8 cells.

    A reading is copied to the blocks within ``radius`` cells only (1.56 copies on average for
    r = 1, where sending it to every cell would make nine); a copy carries place, order and
    amplitude. Readings without a position are left out.
    """
    order = list(READING_ORDER)
    sent = sent_to_blocks(readings, size, radius).select(
        *BLOCK,
        *CELL,
        *order,
        F.col("seismic_amplitude").cast("double").alias("amount"),
        F.col(HOME).alias("in_block"),
        *[F.when(F.col(HOME), F.col(c)).alias(c) for c in readings.columns if c not in order],
    )
    schema = T.StructType(
        [*readings.schema.fields, T.StructField("neighbourhood_avg", T.DoubleType())]
    )
    average = F.col("neighbourhood_avg")
    return stateful(sent, BLOCK, BlockMeans(readings.columns, radius), schema).withColumn(
        "spatial_ratio",
        F.when(average > 0, F.col("seismic_amplitude").cast("double") / average).otherwise(
            F.lit(0.0)
        ),
    )


def _per_sensor(readings: DataFrame, processor: StatefulProcessor, delay: str | None) -> DataFrame:
    if delay is None:
        return stateful(readings, ["sensor_id"], processor, readings.schema)
    timed = readings.withColumn("event_time", event_time()).withWatermark("event_time", delay)
    return stateful(timed, ["sensor_id"], processor, timed.schema, "EventTime", "event_time")


def stateful(
    df: DataFrame,
    keys: list[str],
    processor: StatefulProcessor,
    schema: T.StructType,
    time_mode: str = "None",
    event_time_column: str = "",
) -> DataFrame:
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=schema,
        outputMode="Append",
        timeMode=time_mode,
        eventTimeColumnName=event_time_column,
    )
