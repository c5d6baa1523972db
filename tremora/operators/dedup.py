"""Near-duplicate suppression per sensor, and what changes between kept readings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tremora.operators.chunks import PIECE, PiecePlan, over_recent_rows, plan_pieces
from tremora.schemas import READING_ORDER

SENSOR = "sensor_id"
TS, ID = READING_ORDER
CREATED = "__created"
DUPLICATE = "is_duplicate"


def close_amplitude(threshold: float):
    """Test |a - b| < threshold on amplitudes held as doubles, as if subtracted as floats."""
    surely, possibly = threshold * (1 - 1e-6), threshold * (1 + 1e-6)

    def test(a: float, b: float) -> bool:
        diff = abs(a - b)
        return diff < surely or (diff < possibly and float(np.float32(diff)) < threshold)

    return test


def plan_sensors(readings: DataFrame, **limits: int) -> PiecePlan:
    """Look for sensors with too many readings for one task and cut them along time."""
    return plan_pieces(readings, [SENSOR], TS, **limits)


# --- baseline = last kept reading ---------------------------------------------------


def flag_last_kept(
    readings: DataFrame,
    amplitude_threshold: float = 0.5,
    gap_ms: int = 100,
    ttl_ms: int = 60_000,
    plan: PiecePlan | None = None,
    enabled: bool = True,
) -> DataFrame:
    """Add is_duplicate: closer than both thresholds to the last kept reading.

    A duplicate leaves the baseline as it is; a kept reading replaces it. A baseline ends
    ``ttl_ms`` after it was first set, however often it was replaced since; the reading
    after that is kept and sets a new one.

    Each decision depends on the one before, so a sensor's readings stream in order
    through a fold that holds one baseline, never a group. Sensors that ``plan`` cuts
    are folded in segments between two readings whose outcome needs no history; see
    _segments.
    """
    if not enabled:
        return readings.withColumn(DUPLICATE, F.lit(False))

    if plan is None or plan.is_whole:
        spread = [SENSOR]
        keyed = readings.withColumns(
            {PIECE: F.lit(-1).cast("bigint"), CREATED: F.lit(None).cast("bigint")}
        )
    else:
        spread = [SENSOR, PIECE]
        assigned = plan.assign(readings)
        segments = _segments(plan.only_cut(assigned), gap_ms, ttl_ms)
        own = F.coalesce(F.col(TS) >= F.col("start_from"), F.lit(True))
        keyed = (
            assigned.join(segments, [SENSOR, PIECE], "left")
            .withColumns(
                {
                    PIECE: F.when(own, F.col(PIECE)).otherwise(F.col("owner")),
                    CREATED: F.when(own, F.col("created")).otherwise(F.col("owner_created")),
                }
            )
            .select(*readings.columns, PIECE, CREATED)
        )
    ordered = keyed.repartition(*spread).sortWithinPartitions(SENSOR, PIECE, TS, ID)
    schema = T.StructType([*readings.schema.fields, T.StructField(DUPLICATE, T.BooleanType())])
    return ordered.mapInArrow(_fold(amplitude_threshold, gap_ms, ttl_ms), schema)


def dedup_last_kept(readings: DataFrame, *args, **kwargs) -> DataFrame:
    """flag_last_kept, duplicates removed."""
    return flag_last_kept(readings, *args, **kwargs).where(~F.col(DUPLICATE)).drop(DUPLICATE)


def _fold(amplitude_threshold: float, gap_ms: int, ttl_ms: int):
    """The decision over readings sorted by (sensor, piece, time, id).

    State crosses Arrow batches. The other columns pass through untouched. A reading at least
    ``gap_ms`` after the one before it is kept whatever came before, and when baselines end
    follows from times alone; both are found for a whole batch at once, and only the readings
    in between are looked at one by one.
    """
    close = close_amplitude(amplitude_threshold)

    def fold(ts, amps, created, base_ts, base_amp):
        """Flags of one key's readings in a batch, and the state after them."""
        fresh = np.zeros(len(ts), bool)  # sets a new baseline because the last one has ended
        at = 0
        if created is not None:
            at = int(np.searchsorted(ts, created + ttl_ms, side="right"))
        while at < len(ts):
            fresh[at] = True
            created = int(ts[at])
            at = int(np.searchsorted(ts, created + ttl_ms, side="right"))
        before = ts[0] - gap_ms if base_ts is None else base_ts
        sure = fresh | (np.diff(ts, prepend=before) >= gap_ms)
        flags = np.zeros(len(ts), bool)
        position = -1
        for i in np.flatnonzero(~sure).tolist():
            if position < i - 1:  # the readings in between were kept
                base_ts, base_amp = int(ts[i - 1]), float(amps[i - 1])
            position = i
            if ts[i] - base_ts < gap_ms and close(float(amps[i]), base_amp):
                flags[i] = True
            else:
                base_ts, base_amp = int(ts[i]), float(amps[i])
        if position < len(ts) - 1:
            base_ts, base_amp = int(ts[-1]), float(amps[-1])
        return flags, (created, base_ts, base_amp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, (None, None, None)
        for batch in batches:
            sensors = batch.column(SENSOR).dictionary_encode().indices.fill_null(-1).to_numpy()
            pieces = batch.column(PIECE).to_numpy()
            ts = batch.column(TS).to_numpy()
            amps = batch.column("seismic_amplitude").to_numpy(zero_copy_only=False).astype(float)
            changes = (sensors[1:] != sensors[:-1]) | (pieces[1:] != pieces[:-1])
            bounds = [0, *(np.flatnonzero(changes) + 1).tolist(), len(ts)]
            flags = np.zeros(len(ts), bool)
            for lo, hi in zip(bounds, bounds[1:]):
                if lo == hi:
                    continue
                key = (batch.column(SENSOR)[lo].as_py(), int(pieces[lo]))
                if key != current:
                    current, state = key, (batch.column(CREATED)[lo].as_py(), None, None)
                flags[lo:hi], state = fold(ts[lo:hi], amps[lo:hi], *state)
            kept = [n for n in batch.schema.names if n not in (PIECE, CREATED)]
            yield batch.select(kept).append_column(DUPLICATE, pa.array(flags, pa.bool_()))

    return run


def _segments(cut: DataFrame, gap_ms: int, ttl_ms: int) -> DataFrame:
    """Where each piece of a cut sensor can start folding without knowing its past.

    Two kinds of reading are kept whatever came before: one at least ``gap_ms`` after its
    predecessor, and the first one after the baseline's end. The first kind is local. The
    second needs the time the running baseline was set, which depends on times only:
    it is a chain "next = first reading later than ttl after the current one". Each
    piece is summarised as a function from the chain's last element before the piece to
    its last element inside (a step function over the first ttl of the piece), and the
    functions are applied in piece order, one row per piece.

    Returns one row per piece: readings from ``start_from`` on belong to the piece itself,
    with a baseline set at ``created``; earlier ones continue the segment of ``owner``.
    """
    times = cut.select(SENSOR, PIECE, TS)
    summary = T.StructType(
        [
            T.StructField(SENSOR, T.StringType()),
            T.StructField(PIECE, T.LongType()),
            T.StructField("first_ts", T.LongType()),
            T.StructField("last_ts", T.LongType()),
            T.StructField("gap_ts", T.LongType()),
            T.StructField("entries", T.ArrayType(T.LongType())),
            T.StructField("exits", T.ArrayType(T.LongType())),
        ]
    )

    def summarise(sensor: str, piece: int, t: np.ndarray) -> dict:
        n = len(t)
        following = np.searchsorted(t, t + ttl_ms, side="right")
        last = np.where(following < n, following, np.arange(n))
        while True:  # follow the chain to its end in the piece, doubling the stride
            further = last[last]
            if np.array_equal(further, last):
                break
            last = further
        reachable = min(n, np.searchsorted(t, t[0] + ttl_ms, side="right") + 1)
        entry, leave = t[:reachable], t[last[:reachable]]
        run_end = np.append(leave[1:] != leave[:-1], True)
        gaps = np.flatnonzero(np.diff(t) >= gap_ms)
        return {
            SENSOR: sensor,
            PIECE: piece,
            "first_ts": t[0],
            "last_ts": t[-1],
            "gap_ts": t[gaps[0] + 1] if len(gaps) else None,
            "entries": entry[run_end],
            "exits": leave[run_end],
        }

    made = to_arrow_schema(summary)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per piece, from times sorted by piece; the piece in progress is kept."""
        current, parts = None, []
        for batch in batches:
            sensors = batch.column(SENSOR).dictionary_encode().indices.fill_null(-1).to_numpy()
            pieces, ts = batch.column(PIECE).to_numpy(), batch.column(TS).to_numpy()
            changes = (sensors[1:] != sensors[:-1]) | (pieces[1:] != pieces[:-1])
            bounds = [0, *(np.flatnonzero(changes) + 1).tolist(), len(ts)]
            rows = []
            for lo, hi in zip(bounds, bounds[1:]):
                if lo == hi:
                    continue
                key = (batch.column(SENSOR)[lo].as_py(), int(pieces[lo]))
                if key != current:
                    if parts:
                        rows.append(summarise(*current, np.concatenate(parts)))
                    current, parts = key, []
                parts.append(ts[lo:hi])
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=made)
        if parts:
            yield pa.RecordBatch.from_pylist([summarise(*current, np.concatenate(parts))], schema=made)

    result = T.StructType(
        [
            T.StructField(SENSOR, T.StringType()),
            T.StructField(PIECE, T.LongType()),
            T.StructField("start_from", T.LongType()),
            T.StructField("created", T.LongType()),
            T.StructField("owner", T.LongType()),
            T.StructField("owner_created", T.LongType()),
        ]
    )

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sensor = created = owner = owner_created = previous_ts = None
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False, name=None):
                key, piece, first_ts, last_ts, gap_ts, entries, exits = row
                if key != sensor:
                    sensor, created, owner, owner_created, previous_ts = key, None, None, None, None
                if created is None or first_ts > created + ttl_ms or (
                    first_ts - previous_ts >= gap_ms
                ):
                    start_from = first_ts
                else:
                    start_from = created + ttl_ms + 1
                    if not pd.isna(gap_ts):
                        start_from = min(start_from, int(gap_ts))
                rows.append((key, piece, start_from, created, owner, owner_created))
                if last_ts >= start_from:
                    owner, owner_created = piece, created
                entries = np.asarray(entries)
                after = -1 if created is None else created + ttl_ms
                hit = 0 if created is None else np.searchsorted(entries, after, side="right")
                if hit < len(entries):
                    created = int(exits[hit])
                previous_ts = last_ts
            frame = pd.DataFrame(rows, columns=result.fieldNames())
            longs = result.fieldNames()[1:]
            yield frame.astype(dict.fromkeys(longs, "Int64"))

    return (
        times.repartition(SENSOR, PIECE)
        .sortWithinPartitions(SENSOR, PIECE, TS)
        .mapInArrow(summaries, summary)
        .repartition(SENSOR)
        .sortWithinPartitions(SENSOR, PIECE)
        .mapInPandas(compose, result)
    )


# --- baseline = first reading -------------------------------------------------------


def flag_first_seen(
    readings: DataFrame, amplitude_threshold: float = 0.01, gap_ms: int = 500
) -> DataFrame:
    """Add is_duplicate: closer than both thresholds to the sensor's very first reading.

    The first readings come from a hash aggregation, one row per sensor, and are joined
    back. Spark broadcasts them when their measured size allows it; otherwise adaptive
    execution splits the partitions of busy sensors.
    """
    # (time, id) as one exact number: a struct would force a sort-based aggregation.
    rank = F.expr(f"CAST({TS} AS DECIMAL(16, 0)) * 10000000000000000000BD + {ID}")
    first = readings.groupBy(SENSOR).agg(
        F.min_by("seismic_amplitude", rank).alias("__amp"),
        F.min(TS).alias("__ts"),
        F.min_by(ID, rank).alias("__id"),
    )
    is_first = (F.col(TS) == F.col("__ts")) & (F.col(ID) == F.col("__id"))
    near = (F.abs(F.col("seismic_amplitude") - F.col("__amp")) < amplitude_threshold) & (
        F.abs(F.col(TS) - F.col("__ts")) < gap_ms
    )
    return (
        readings.join(first, SENSOR, "left")
        .withColumn(DUPLICATE, ~is_first & near)
        .select(*readings.columns, DUPLICATE)
    )


def dedup_first_seen(readings: DataFrame, *args, **kwargs) -> DataFrame:
    """flag_first_seen, duplicates removed."""
    return flag_first_seen(readings, *args, **kwargs).where(~F.col(DUPLICATE)).drop(DUPLICATE)


# --- change and statistics ----------------------------------------------------------


def with_change_info(kept: DataFrame, plan: PiecePlan | None = None) -> DataFrame:
    """Add has_previous, amplitude_change, time_diff and previous_amplitude.

    Run it on deduplicated readings: the previous row is then the baseline.
    """

    def columns(window: Window) -> dict[str, Column]:
        return {
            "previous_amplitude": F.lag("seismic_amplitude").over(window),
            "__previous_ts": F.lag(TS).over(window),
        }

    compared = over_recent_rows(
        kept, [SENSOR], READING_ORDER, 1, columns, ["seismic_amplitude"], plan
    )
    return compared.withColumns(
        {
            "has_previous": F.col("__previous_ts").isNotNull(),
            "amplitude_change": F.col("seismic_amplitude") - F.col("previous_amplitude"),
            "time_diff": F.col(TS) - F.col("__previous_ts"),
        }
    ).drop("__previous_ts")


def dedup_stats(flagged: DataFrame) -> DataFrame:
    """Input, output, skipped and skip percentage per sensor, and for all (sensor_id NULL).

    One pass over the flagged readings, combined before the exchange.
    """
    return with_shares(
        flagged.rollup(SENSOR).agg(
            F.count(F.lit(1)).alias("input_count"),
            F.count_if(~F.col(DUPLICATE)).alias("output_count"),
            F.count_if(DUPLICATE).alias("skipped_count"),
        )
    )


def with_shares(counts: DataFrame) -> DataFrame:
    share = F.try_divide(F.col("skipped_count") * F.lit(100.0), F.col("input_count"))
    return counts.withColumn("skip_percent", F.coalesce(share, F.lit(0.0)))


def merged_stats(per_sensor: DataFrame) -> DataFrame:
    """dedup_stats from counts per sensor that were kept elsewhere, such as by a stream."""
    sums = [F.sum(c).alias(c) for c in ("input_count", "output_count", "skipped_count")]
    return with_shares(per_sensor.rollup(SENSOR).agg(*sums))
