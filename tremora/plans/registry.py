"""Registered queries: every operator over the event-derived views.

Thresholds are wider than the defaults because readings of one sensor lie hours apart in
the test tables. Names ending in ``_split`` run the same query with cutting of hot keys
forced, so that path is compared with the same SQL.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.operators import dedup, history, quality, ranking, scaling, spatial
from tremora.operators.chunks import calendar_pieces, plan_pieces
from tremora.operators.windows import DAY_MS, window_agg
from tremora.plans import jobs
from tremora.schemas import AGGREGATE, PAYLOAD, READING
from tremora.session import shared_folder, stored
from tremora.sinks import rolling
from tremora.sinks.text import agg_to_csv, format_agg
from tremora.sources import events, metrics, payloads, segments
from tremora.sinks.streams import to_csv_files
from tremora.sources.readings import read_bounded, read_stream
from tremora.streaming import activity, progress, runner, stateful, tables
from tremora.streaming import alerts as stream_alerts
from tremora.streaming import jobs as stream_jobs
from tremora.streaming.windows import window_agg_stream

Query = Callable[[SparkSession, str], DataFrame]

CELL_SIZE = 0.01
AS_OF = 1_706_659_200_000  # the end of the test period, 2024-01-31
NOW = AS_OF // 1000
LAST_KEPT = {"amplitude_threshold": 20.0, "gap_ms": 21_600_000, "ttl_ms": 864_000_000}
FIRST_SEEN = {"amplitude_threshold": 20.0, "gap_ms": 864_000_000}
POLICY = scaling.Policy(
    rate_high=3000, rate_low=800, cpu_high=0.8, cpu_low=0.5, duration=21_600
)
# Limits in *_split queries: keys above a few dozen rows are cut.
SPLIT = {"target_rows": 25}
ACTIVE_MS = 21_600_000
INSTANTS = (1_704_844_800_000, 1_705_708_800_000, 1_706_400_000_000)
# Sensor histories cut every ten days.
HISTORY_PIECES = calendar_pieces(["sensor_id"], "window_start_ts", 10 * DAY_MS)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return quality.filter_valid(events.readings(spark, sf))


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    """Valid readings so close in time and amplitude that the default thresholds matter."""
    return _valid(spark, sf).withColumns(
        {
            "collect_timestamp": F.expr("collect_timestamp div 360000"),
            "seismic_amplitude": (F.col("seismic_amplitude").cast("double") / 64).cast("float"),
        }
    )


def _agg(spark: SparkSession, sf: str) -> DataFrame:
    return window_agg(_valid(spark, sf), DAY_MS)


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return history.with_history(_agg(spark, sf), 10)


def _temporal(spark: SparkSession, sf: str) -> DataFrame:
    return history.score_temporal(_valid(spark, sf), _history(spark, sf), DAY_MS)


def _grids(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.grid_agg(_valid(spark, sf), CELL_SIZE)


def _grid_output(grids: DataFrame) -> DataFrame:
    return rounded(grids, "sum_amplitude", "avg_amplitude")


def _sensor_plan(valid: DataFrame, **limits: int):
    return dedup.plan_sensors(valid, **limits)


def _flagged(spark: SparkSession, sf: str, **limits: int) -> DataFrame:
    valid = _valid(spark, sf)
    return dedup.flag_last_kept(valid, **LAST_KEPT, plan=_sensor_plan(valid, **limits))


def _kept(spark: SparkSession, sf: str, **limits: int) -> DataFrame:
    return _flagged(spark, sf, **limits).where("NOT is_duplicate").drop("is_duplicate")


def _change_info(spark: SparkSession, sf: str, **limits: int) -> DataFrame:
    valid = _valid(spark, sf)
    plan = _sensor_plan(valid, **limits)
    kept = dedup.dedup_last_kept(valid, **LAST_KEPT, plan=plan)
    if not plan.is_whole:
        kept = stored(kept, "kept")
    return dedup.with_change_info(kept, plan).select(
        "sensor_id",
        "event_id",
        "collect_timestamp",
        "seismic_amplitude",
        "has_previous",
        "amplitude_change",
        "time_diff",
        "previous_amplitude",
    )


def _scored(spark: SparkSession, sf: str, **limits: int) -> DataFrame:
    valid = _valid(spark, sf)
    plan = spatial.plan_blocks(valid, CELL_SIZE, **limits)
    return spatial.score_spatial(valid, CELL_SIZE, 1, plan)


def _score_output(scored: DataFrame, *more: str) -> DataFrame:
    return rounded(
        scored.select(
            "event_id",
            "sensor_id",
            "collect_timestamp",
            "seismic_amplitude",
            "neighbourhood_avg",
            "spatial_ratio",
            *more,
        ),
        "neighbourhood_avg",
        "spatial_ratio",
    )


def _history_output(scored: DataFrame) -> DataFrame:
    columns = ["avg_amplitude", "history_avg", "deviation"]
    return rounded(scored.select("sensor_id", "window_start_ts", *columns), *columns)


def _temporal_output(scored: DataFrame) -> DataFrame:
    return rounded(
        scored.select(
            "event_id",
            "sensor_id",
            "collect_timestamp",
            "seismic_amplitude",
            "history_avg",
            "temporal_ratio",
        ),
        "history_avg",
        "temporal_ratio",
    )


def _rates(spark: SparkSession, sf: str, **limits: int) -> DataFrame:
    samples = events.counters(spark, sf)
    plan = plan_pieces(samples, ["job_id"], "ts", **limits)
    return scaling.counter_rate(samples, order=("ts", "sample_id"), plan=plan)


# --- sources ------------------------------------------------------------------------


def payload_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = payloads.split_decoded(payloads.decode_payloads(events.payloads(spark, sf)))
    return good


def payload_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = payloads.split_decoded(payloads.decode_payloads(events.payloads(spark, sf)))
    return bad.select("event_id", F.hex("bad_payload").alias("payload_hex"))


def bounded_read(spark: SparkSession, sf: str) -> DataFrame:
    return read_bounded(events.readings(spark, sf), 1000)


def _log(spark: SparkSession, sf: str) -> str:
    """A metrics log as text files: a line per sample, and odd lines beside them."""
    folder = shared_folder(spark, "metrics-log")
    samples = events.metrics(spark, sf)
    metrics.format_metrics(samples).write.text(folder)
    # Cut short, marked, or with nothing after the time: lines of another shape.
    odd = samples.where("sample_id % 50 = 0").select(
        F.when(F.col("sample_id") % 3 == 0, F.concat(F.lit("? "), metrics.log_line()))
        .when(F.col("sample_id") % 3 == 1, F.concat_ws(",", F.col("ts").cast("string"), F.lit("throughput:1")))
        .otherwise(F.col("ts").cast("string"))
        .alias("value")
    )
    odd.write.mode("append").text(folder)
    return folder


def metrics_log(spark: SparkSession, sf: str) -> DataFrame:
    log = metrics.read_metrics_log(spark, _log(spark, sf), "job")
    return log.select("ts", "throughput", "cpu")


def metrics_log_odd(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.odd_lines(spark.read.text(_log(spark, sf))).select(F.col("value").alias("line"))


def log_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """From text logs, a folder per job, to alerts at a fixed size of the jobs."""
    folder = shared_folder(spark, "job-logs")
    samples = events.metrics(spark, sf)
    lines = samples.select("job_id", metrics.log_line().alias("value"))
    lines.write.partitionBy("job_id").text(folder)
    logged = metrics.read_job_logs(spark, folder).withColumns(
        {"parallelism": F.lit(6), "worker_count": F.lit(4)}
    )
    return jobs.scaling_alerts(logged, NOW, POLICY).select("job_id", "ts", "alert")


# --- quality ------------------------------------------------------------------------


def reject_report(spark: SparkSession, sf: str) -> DataFrame:
    report = quality.reject_report(events.readings(spark, sf))
    return report.withColumn("failed_rules", F.concat_ws(",", "failed_rules"))


def critical_readings(spark: SparkSession, sf: str) -> DataFrame:
    return quality.with_critical(_valid(spark, sf)).select(
        "event_id", "sensor_id", "seismic_amplitude", "is_critical"
    )


# --- streams ------------------------------------------------------------------------


SLICES, FILES_PER_SLICE = 3, 2


def _write_arrivals(folder: str, parts: list[DataFrame]) -> None:
    """Append slices of time one after the other: files arrive in time order."""
    for part in parts:
        part.repartition(FILES_PER_SLICE).write.mode("append").parquet(folder)


def _flush(spark: SparkSession) -> DataFrame:
    """A reading far behind all others: the watermark passes every window but its own."""
    row = (-1, "sensor_9999_flush", AS_OF + 30 * DAY_MS, 108.0, 34.0, 0, 1.0, 10, "P", 1, 5)
    return spark.createDataFrame([row], READING)


def _arrivals(spark: SparkSession, sf: str, flush: bool = False) -> str:
    folder = shared_folder(spark, "arrivals")
    readings = events.readings(spark, sf).select(READING.fieldNames())
    _write_arrivals(folder, events.time_slices(readings, "collect_timestamp", SLICES))
    if flush:
        _flush(spark).write.mode("append").parquet(folder)
    return folder


def _replay(spark: SparkSession, sf: str) -> DataFrame:
    """The valid readings as a stream of one slice after the other."""
    return quality.filter_valid(read_stream(spark, _arrivals(spark, sf), FILES_PER_SLICE))


def _flushed(spark: SparkSession, sf: str) -> DataFrame:
    return read_stream(spark, _arrivals(spark, sf, flush=True), FILES_PER_SLICE)


def _append(spark: SparkSession, stream: DataFrame, purpose: str) -> DataFrame:
    """Run a stream to the end and read back what it wrote."""
    folder = shared_folder(spark, purpose)
    with runner.stream_settings(spark):
        runner.append_to_table(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _current(spark: SparkSession, aggregates: DataFrame, purpose: str) -> DataFrame:
    folder = shared_folder(spark, purpose)
    with runner.stream_settings(spark):
        runner.changes_to_table(aggregates, f"{folder}/out", f"{folder}/state").awaitTermination()
    changes = runner.read_changes(spark, f"{folder}/out", aggregates.schema)
    return runner.latest(changes, ["sensor_id", "window_start_ts", "window_end_ts"]).select(
        AGGREGATE.fieldNames()
    )


def stream_window_agg(spark: SparkSession, sf: str) -> DataFrame:
    stream = window_agg_stream(_replay(spark, sf), "1 day", "1 day")
    return rounded(_current(spark, stream, "stream-window-agg"), "avg_amplitude")


def stream_processing_time(spark: SparkSession, sf: str) -> DataFrame:
    """Totals per sensor: which window a reading falls into depends on the clock, these do not."""
    stream = window_agg_stream(_replay(spark, sf), "1 second", time="processing")
    counts = ["total_count", "p_phase_count", "s_phase_count", "n_phase_count"]
    return (
        _current(spark, stream, "stream-processing-time")
        .groupBy("sensor_id")
        .agg(
            *[F.sum(c).alias(c) for c in counts],
            F.max("max_amplitude").alias("max_amplitude"),
            F.min("min_amplitude").alias("min_amplitude"),
        )
    )


def stream_dedup_last_kept(spark: SparkSession, sf: str) -> DataFrame:
    stream = stateful.dedup_last_kept_stream(_replay(spark, sf), **LAST_KEPT)
    return _append(spark, stream, "stream-last-kept")


def stream_restarted(spark: SparkSession, sf: str) -> DataFrame:
    """Last-kept dedup that stops after the first slices and goes on with the later ones."""
    folder = shared_folder(spark, "stream-restart")
    readings = events.readings(spark, sf).select(READING.fieldNames())
    parts = events.time_slices(readings, "collect_timestamp", SLICES)
    for arriving in (parts[:1], parts[1:]):
        _write_arrivals(f"{folder}/in", arriving)
        source = quality.filter_valid(read_stream(spark, f"{folder}/in", FILES_PER_SLICE))
        stream = stateful.dedup_last_kept_stream(source, **LAST_KEPT)
        with runner.stream_settings(spark):
            runner.append_to_table(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(READING).parquet(f"{folder}/out")


def stream_dedup_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    stream = stateful.dedup_first_seen_stream(_replay(spark, sf), **FIRST_SEEN)
    return _append(spark, stream, "stream-first-seen")


def stream_spatial_scores(spark: SparkSession, sf: str) -> DataFrame:
    stream = stateful.score_spatial_stream(_replay(spark, sf), CELL_SIZE)
    return _score_output(_append(spark, stream, "stream-spatial"))


def stream_last_kept_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams: kept readings to a table, and that table to window aggregates."""
    folder = shared_folder(spark, "stream-kept")
    kept = stateful.dedup_last_kept_stream(_replay(spark, sf), **LAST_KEPT)
    with runner.stream_settings(spark):
        runner.append_to_table(kept, f"{folder}/out", f"{folder}/state").awaitTermination()
    readings = spark.readStream.schema(READING).parquet(f"{folder}/out")
    stream = window_agg_stream(readings, "1 day", "1 day")
    return rounded(_current(spark, stream, "stream-kept-agg"), "avg_amplitude")


def stream_filter_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    stream = stream_jobs.filter_aggregate_stream(_flushed(spark, sf), "1 day", "1 hour")
    return _append(spark, stream, "stream-p1").select("sensor_id", "window_start_ts", "line")


def stream_first_seen_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    stream = stream_jobs.first_seen_aggregate_stream(
        _flushed(spark, sf), "1 day", "1 hour", **FIRST_SEEN
    )
    return _append(spark, stream, "stream-p2").select("sensor_id", "window_start_ts", "line")


def stream_last_kept_job(spark: SparkSession, sf: str) -> DataFrame:
    """Dedup, aggregate, history and line in one stream that is stopped and started again."""
    folder = shared_folder(spark, "stream-p3")
    readings = events.readings(spark, sf).select(READING.fieldNames())
    parts = [*events.time_slices(readings, "collect_timestamp", SLICES), _flush(spark)]
    for arriving in (parts[:2], parts[2:]):
        _write_arrivals(f"{folder}/in", arriving)
        source = read_stream(spark, f"{folder}/in", FILES_PER_SLICE)
        stream = stream_jobs.last_kept_history_stream(source, "1 day", "1 hour", 10, **LAST_KEPT)
        with runner.stream_settings(spark):
            runner.append_to_table(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    scored = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    columns = ["sensor_id", "window_start_ts", "line", "history_avg", "deviation"]
    return rounded(scored.select(*columns), "history_avg", "deviation")


def stream_log_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """log_alerts from log files that arrive one slice of time after the other."""
    folder = shared_folder(spark, "stream-logs")
    for part in events.time_slices(events.metrics(spark, sf), "ts", SLICES):
        lines = part.select("job_id", metrics.log_line().alias("value"))
        lines.repartition(FILES_PER_SLICE, "job_id").write.mode("append").partitionBy("job_id").text(f"{folder}/in")
    logged = stream_alerts.read_job_logs_stream(spark, f"{folder}/in", 16).withColumns(
        {"parallelism": F.lit(6), "worker_count": F.lit(4)}
    )
    found = stream_alerts.scaling_alerts_stream(logged, NOW, POLICY, delay="30 days")
    return _append(spark, found, "stream-alerts").select("job_id", "ts", "alert")


def stream_payloads(spark: SparkSession, sf: str, bad: bool = False) -> DataFrame:
    """Payloads as a stream to two tables, stopped and started again on the way."""
    folder = shared_folder(spark, "stream-payloads")
    encoded = events.payloads(spark, sf)
    for k in range(2):
        encoded.where(F.col("event_id") % 2 == k).repartition(FILES_PER_SLICE).write.mode("append").parquet(f"{folder}/in")
        source = read_stream(spark, f"{folder}/in", 1, PAYLOAD)
        decoded = payloads.decode_payloads(source)
        out = (f"{folder}/good", f"{folder}/bad")
        tables.decoded_to_tables(decoded, *out, f"{folder}/state").awaitTermination()
    shapes = [part.schema for part in payloads.split_decoded(decoded)]
    return tables.read_batches(spark, out[bad], shapes[bad])


def stream_queues(spark: SparkSession, sf: str) -> DataFrame:
    """Readings through logs of four queues: read in parts, stopped, and gone on after more came."""
    folder = shared_folder(spark, "stream-queues")
    readings = events.readings(spark, sf).select(READING.fieldNames())
    for part in events.time_slices(readings, "collect_timestamp", SLICES):
        line = F.to_json(F.struct(*READING.fieldNames())).alias("value")
        rows = part.select(F.format_string("q%d", F.pmod("event_id", F.lit(4))).alias("queue"), line, "event_id")
        segments.append_segments(rows, f"{folder}/logs", "event_id")
        records = segments.read_segments_stream(spark, f"{folder}/logs", split_bytes=100_000)
        found = records.select(F.from_json("value", READING).alias("r")).select("r.*")
        runner.append_to_table(found, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(READING).parquet(f"{folder}/out")


def stream_payload_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    found = stream_payloads(spark, sf, bad=True)
    return found.select("event_id", F.hex("bad_payload").alias("payload_hex"))


def stream_activity(spark: SparkSession, sf: str) -> DataFrame:
    """Sensors active at three instants, from the changes that a stream told."""
    stream = activity.activity_stream(quality.filter_valid(_flushed(spark, sf)), ACTIVE_MS, "1 hour")
    changes = _append(spark, stream, "stream-activity")
    found = [activity.active_at(changes, at).withColumn("as_of", F.lit(at)) for at in INSTANTS]
    return found[0].union(found[1]).union(found[2])


def stream_compacted_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Window aggregates through a change log that is compacted on the way."""
    folder = shared_folder(spark, "stream-compacted")
    keys = ["sensor_id", "window_start_ts", "window_end_ts"]
    stream = window_agg_stream(_replay(spark, sf), "1 day", "1 day")
    with runner.stream_settings(spark):
        query = tables.changes_to_compacted_table(stream, f"{folder}/out", f"{folder}/state", keys, every=2)
        query.awaitTermination()
    current = tables.read_current(spark, f"{folder}/out", stream.schema, keys)
    return rounded(current.select(AGGREGATE.fieldNames()), "avg_amplitude")


def stream_dedup_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Running deduplication statistics, read from a compacted change log."""
    folder = shared_folder(spark, "stream-stats")
    stream = stateful.dedup_stats_stream(_replay(spark, sf), **LAST_KEPT)
    with runner.stream_settings(spark):
        tables.changes_to_compacted_table(
            stream, f"{folder}/out", f"{folder}/state", ["sensor_id"], every=2, mode="append"
        ).awaitTermination()
    current = tables.read_current(spark, f"{folder}/out", stream.schema, ["sensor_id"])
    return rounded(dedup.merged_stats(current), "skip_percent")


def stream_rolled_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregates to CSV files that roll by size and idle time, read back."""
    folder = shared_folder(spark, "stream-rolled").removeprefix("file://")
    arrivals = _arrivals(spark, sf, flush=True)
    wanted = spark.read.schema(READING).parquet(arrivals).count()
    valid = quality.filter_valid(read_stream(spark, arrivals, FILES_PER_SLICE))
    lines = agg_to_csv(window_agg_stream(valid, "1 day", "1 hour"))
    files = rolling.rolled(runner.observe_stage(lines, "lines"), "csv", slots=3, max_bytes=8_000, idle_ms=1_000)
    with runner.stream_settings(spark):
        query = rolling.write_rolled(files, f"{folder}/out", f"{folder}/state", "2 seconds")
    schema = T.StructType(AGGREGATE.fields[:9])
    for _ in range(150):  # until all is read, the watermark has moved, and the last files have rolled
        time.sleep(1)
        batches = query.recentProgress
        counts = [p.observedMetrics["lines"]["records"] for p in batches if "lines" in p.observedMetrics]
        read = sum(p.numInputRows for p in batches) >= wanted
        if read and sum(counts) and not any(p.numInputRows for p in batches[-3:]) and not any(counts[-3:]):
            if spark.read.schema(schema).csv(f"{folder}/out").count() == sum(counts):
                break
    query.stop()
    return rounded(spark.read.schema(schema).csv(f"{folder}/out"), "avg_amplitude")


def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Records that passed each stage of a stream, from the progress of its micro-batches."""
    folder = shared_folder(spark, "stream-progress")
    read = runner.observe_stage(read_stream(spark, _arrivals(spark, sf), FILES_PER_SLICE), "read")
    stream = runner.observe_stage(quality.filter_valid(read), "valid")
    log = progress.ProgressLog(spark, f"{folder}/progress")
    spark.streams.addListener(log)
    try:
        runner.append_to_table(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(log)
    totals = progress.stage_totals(progress.read_progress(spark, f"{folder}/progress"))
    return totals.select("stage", "records")


def stream_csv_files(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregates to rolling CSV files, read back."""
    folder = shared_folder(spark, "stream-csv")
    valid = quality.filter_valid(_flushed(spark, sf))
    stream = window_agg_stream(valid, "1 day", "1 hour")
    with runner.stream_settings(spark):
        writer = to_csv_files(stream, f"{folder}/out", f"{folder}/state", None, max_records=1000)
        writer.start().awaitTermination()
    return rounded(spark.read.schema(AGGREGATE).csv(f"{folder}/out"), "avg_amplitude")


def registered() -> dict[str, Query]:
    queries: dict[str, Query] = {
        "payload_roundtrip": payload_roundtrip,
        "payload_quarantine": payload_quarantine,
        "bounded_read": bounded_read,
        "metrics_log": metrics_log,
        "metrics_log_odd": metrics_log_odd,
        "log_alerts": log_alerts,
        "valid_readings": _valid,
        "reject_report": reject_report,
        "reject_counts": lambda s, d: quality.reject_counts(events.readings(s, d)),
        "critical_readings": critical_readings,
        "decoded_line": lambda s, d: jobs.decode_lines(events.payloads(s, d)).select(
            "event_id", "line"
        ),
        "window_agg": lambda s, d: rounded(_agg(s, d), "avg_amplitude"),
        "window_agg_negative": lambda s, d: rounded(
            _agg(s, d).where("max_amplitude < 0"), "avg_amplitude"
        ),
        "agg_line": lambda s, d: format_agg(_agg(s, d)).select(
            "sensor_id", "window_start_ts", "line"
        ),
        "agg_csv": lambda s, d: agg_to_csv(
            rounded(_agg(s, d), "avg_amplitude", places=3)
        ).select("sensor_id", "window_start_ts", "csv"),
        "history_baseline": lambda s, d: _history_output(_history(s, d)),
        "history_baseline_split": lambda s, d: _history_output(
            history.with_history(stored(_agg(s, d), "aggregates"), 10, HISTORY_PIECES)
        ),
        "history_max": lambda s, d: _history(s, d).select(
            "sensor_id", "window_start_ts", "history_max"
        ),
        "last_windows": lambda s, d: rounded(
            history.last_windows(_agg(s, d), 3).select(
                "sensor_id", "window_start_ts", "avg_amplitude", "age_rank"
            ),
            "avg_amplitude",
        ),
        "window_step_deviation": lambda s, d: rounded(
            history.with_step_deviation(_agg(s, d)).select(
                "sensor_id", "window_start_ts", "step_deviation"
            ),
            "step_deviation",
        ),
        "window_step_deviation_split": lambda s, d: rounded(
            history.with_step_deviation(stored(_agg(s, d), "aggregates"), HISTORY_PIECES).select(
                "sensor_id", "window_start_ts", "step_deviation"
            ),
            "step_deviation",
        ),
        "temporal_scores": lambda s, d: _temporal_output(_temporal(s, d)),
        "temporal_anomalies": lambda s, d: _temporal_output(
            _temporal(s, d).where(history.temporal_anomaly(0.5))
        ),
        "history_coverage": lambda s, d: rounded(
            history.history_coverage(_history(s, d)), "hit_rate"
        ),
        "grid_keys": lambda s, d: spatial.with_grid(_valid(s, d), CELL_SIZE).select(
            "event_id", "gx", "gy", "grid_key"
        ),
        "grid_agg": lambda s, d: _grid_output(_grids(s, d)),
        "grid_agg_by_sensor": lambda s, d: _grid_output(
            spatial.grid_agg(_valid(s, d), CELL_SIZE, by_sensor=True)
        ),
        "grid_merge": lambda s, d: _grid_output(
            spatial.merge_grids(spatial.grid_agg(_valid(s, d), CELL_SIZE, by_sensor=True))
        ),
        "neighbour_keys": lambda s, d: spatial.neighbour_keys(_grids(s, d)),
        "neighbourhood_agg": lambda s, d: _grid_output(spatial.neighbourhood_agg(_grids(s, d))),
        "latest_grids": lambda s, d: _grid_output(spatial.latest_grids(_grids(s, d), 10)),
        "spatial_scores": lambda s, d: _score_output(_scored(s, d)),
        "spatial_scores_split": lambda s, d: _score_output(_scored(s, d, **SPLIT)),
        "spatial_anomalies": lambda s, d: _score_output(
            _scored(s, d).where(spatial.spatial_anomaly(0.5))
        ),
        "regional_anomalies": lambda s, d: _score_output(
            _scored(s, d).where(spatial.regional_anomaly(0.5))
        ),
        "dedup_last_kept": _kept,
        "dedup_last_kept_split": lambda s, d: _kept(s, d, **SPLIT),
        "dedup_last_kept_defaults": lambda s, d: dedup.dedup_last_kept(_dense(s, d)).select(
            "event_id", "sensor_id", "collect_timestamp"
        ),
        "dedup_off": lambda s, d: dedup.dedup_last_kept(_valid(s, d), enabled=False),
        "dedup_first_seen": lambda s, d: dedup.dedup_first_seen(_valid(s, d), **FIRST_SEEN),
        "dedup_stats": lambda s, d: rounded(dedup.dedup_stats(_flagged(s, d)), "skip_percent"),
        "change_info": _change_info,
        "change_info_split": lambda s, d: _change_info(s, d, **SPLIT),
        "active_sensors": lambda s, d: ranking.active_sensors(
            _valid(s, d), 1_705_708_800_000, 21_600_000
        ),
        "kth_access": lambda s, d: ranking.kth_access(_valid(s, d)),
        "access_frequency": lambda s, d: rounded(
            ranking.access_frequency(_valid(s, d), AS_OF), "frequency", places=9
        ),
        "decayed_frequency": lambda s, d: rounded(
            ranking.decayed_frequency(_valid(s, d), AS_OF, 0.99999), "decayed_frequency"
        ),
        "coldest_sensors": lambda s, d: ranking.coldest(_valid(s, d), n=20),
        "hottest_sensors": lambda s, d: ranking.hottest(_valid(s, d), n=20),
        "counter_rate": _rates,
        "counter_rate_split": lambda s, d: _rates(s, d, **SPLIT),
        "mean_load": lambda s, d: scaling.mean_load(events.node_loads(s, d)),
        "metrics_retention": lambda s, d: scaling.retain(events.metrics(s, d), NOW),
        "sustained_threshold": sustained_threshold,
        "scaling_recommendation": lambda s, d: scaling.recommend(
            events.metrics(s, d), POLICY
        ).select(
            "sample_id", "job_id", "ts", "rule", "action", "target_parallelism", "target_workers"
        ),
        "scaling_alerts": lambda s, d: jobs.scaling_alerts(
            events.metrics(s, d), NOW, POLICY
        ).select("sample_id", "job_id", "ts", "alert"),
        "stage_counts": lambda s, d: quality.stage_counts(events.readings(s, d), _flagged(s, d)),
        "filter_aggregate": lambda s, d: jobs.filter_aggregate(
            events.readings(s, d), DAY_MS
        ).select("sensor_id", "window_start_ts", "line"),
        "first_seen_aggregate": lambda s, d: jobs.first_seen_aggregate(
            events.readings(s, d), DAY_MS, **FIRST_SEEN
        ).select("sensor_id", "window_start_ts", "line"),
        "last_kept_aggregate": last_kept_aggregate,
        "last_kept_spatial": last_kept_spatial,
        "last_kept_job": last_kept_job,
        "stream_window_agg": stream_window_agg,
        "stream_processing_time": stream_processing_time,
        "stream_dedup_last_kept": stream_dedup_last_kept,
        "stream_dedup_first_seen": stream_dedup_first_seen,
        "stream_spatial_scores": stream_spatial_scores,
        "stream_last_kept_aggregate": stream_last_kept_aggregate,
        "stream_restarted": stream_restarted,
        "stream_filter_aggregate": stream_filter_aggregate,
        "stream_first_seen_aggregate": stream_first_seen_aggregate,
        "stream_last_kept_job": stream_last_kept_job,
        "stream_csv_files": stream_csv_files,
        "stream_log_alerts": stream_log_alerts,
        "stream_payload_roundtrip": stream_payloads,
        "stream_payload_quarantine": stream_payload_quarantine,
        "stream_activity": stream_activity,
        "stream_queues": stream_queues,
        "stream_compacted_windows": stream_compacted_windows,
        "stream_progress": stream_progress,
        "stream_rolled_csv": stream_rolled_csv,
        "stream_dedup_stats": stream_dedup_stats,
        "neighbourhood_agg_wide": lambda s, d: _grid_output(spatial.neighbourhood_agg(_grids(s, d), 10)),
    }
    return queries


def sustained_threshold(spark: SparkSession, sf: str) -> DataFrame:
    conditions = {
        "rate_high": F.col("throughput") > POLICY.rate_high,
        "rate_low": F.col("throughput") < POLICY.rate_low,
        "cpu_high": F.col("cpu") > POLICY.cpu_high,
        "cpu_low": F.col("cpu") < POLICY.cpu_low,
    }
    return scaling.sustained(events.metrics(spark, sf), conditions, POLICY.duration).select(
        "sample_id", "job_id", "ts", *conditions
    )


def last_kept_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    scored = jobs.last_kept_aggregate(
        events.readings(spark, sf),
        DAY_MS,
        plan=_sensor_plan(_valid(spark, sf)),
        **LAST_KEPT,
    )
    return rounded(
        scored.select("sensor_id", "window_start_ts", "line", "history_avg", "deviation"),
        "history_avg",
        "deviation",
    )


def last_kept_spatial(spark: SparkSession, sf: str) -> DataFrame:
    valid = _valid(spark, sf)
    scored = jobs.last_kept_spatial(
        events.readings(spark, sf),
        CELL_SIZE,
        plan=_sensor_plan(valid),
        block_plan=spatial.plan_blocks(valid, CELL_SIZE),
        **LAST_KEPT,
    )
    return _score_output(scored, "is_spatial_anomaly")


def last_kept_job(spark: SparkSession, sf: str) -> DataFrame:
    valid = _valid(spark, sf)
    found = jobs.last_kept_job(
        events.readings(spark, sf), CELL_SIZE, DAY_MS, plan=_sensor_plan(valid), **LAST_KEPT
    )
    columns = ["is_spatial_anomaly", "window_start_ts", "avg_amplitude", "history_avg", "deviation"]
    return rounded(_score_output(found, *columns), "avg_amplitude", "history_avg", "deviation")
