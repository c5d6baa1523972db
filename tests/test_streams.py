"""Streams over several files: equal to batch, and no loss or doubles over a restart."""

from __future__ import annotations

import os
import re
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from tremora.operators import dedup, quality, spatial
from tremora.operators.windows import DAY_MS, window_agg
from tremora.plans import registry
from tremora.schemas import AGGREGATE
from tremora.sinks.streams import to_csv_files, to_memory
from tremora.sinks.text import format_agg
from tremora.sources import events
from tremora.sources.readings import read_stream
from tremora.streaming import jobs, runner, stateful
from tremora.streaming.windows import window_agg_stream

FILES = 4
LAST_KEPT = (20.0, 21_600_000, 864_000_000)


@pytest.fixture(scope="module")
def valid(spark, data_dir):
    return quality.filter_valid(events.readings(spark, data_dir))


@pytest.fixture(scope="module")
def slices(valid):
    """The readings in four slices of time."""
    edges = valid.approxQuantile("collect_timestamp", [i / FILES for i in range(1, FILES)], 0.0)
    edges = [float("-inf"), *edges, float("inf")]
    ts = F.col("collect_timestamp")
    return [valid.where((ts >= lo) & (ts < hi)) for lo, hi in zip(edges, edges[1:])]


def write(slices, folder, which):
    for i in which:
        slices[i].coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # the file source orders files by modification time


@pytest.fixture(scope="module")
def folder(slices, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "in")
    write(slices, path, range(FILES))
    return path


@pytest.fixture(scope="module")
def flushed(spark, slices, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "flushed")
    write(slices, path, range(FILES))
    registry._flush(spark).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, stream, folder, name):
    with runner.stream_settings(spark):
        query = runner.append_to_table(stream, f"{folder}/{name}", f"{folder}/{name}-state")
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/{name}"), query


def as_set(df):
    return sorted(tuple(r) for r in df.collect())


def test_dedup_last_kept(spark, folder, valid, tmp_path):
    stream = stateful.dedup_last_kept_stream(read_stream(spark, folder, 1), *LAST_KEPT)
    out, query = run(spark, stream, tmp_path, "out")
    assert len(query.recentProgress) >= FILES
    assert as_set(out) == as_set(dedup.dedup_last_kept(valid, *LAST_KEPT))


def test_dedup_first_seen(spark, folder, valid, tmp_path):
    stream = stateful.dedup_first_seen_stream(read_stream(spark, folder, 1), 20.0, 864_000_000)
    out, _ = run(spark, stream, tmp_path, "out")
    assert as_set(out) == as_set(dedup.dedup_first_seen(valid, 20.0, 864_000_000))


def test_spatial(spark, folder, valid, tmp_path):
    stream = stateful.score_spatial_stream(read_stream(spark, folder, 1))
    out, _ = run(spark, stream, tmp_path, "out")
    got = {r.event_id: r.neighbourhood_avg for r in out.collect()}
    expected = {r.event_id: r.neighbourhood_avg for r in spatial.score_spatial(valid).collect()}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k], abs=1e-9) for k in got)


def test_windows_by_change_log_are_whole(spark, folder, valid, tmp_path):
    stream = window_agg_stream(read_stream(spark, folder, 1), "1 day", "1 day")
    with runner.stream_settings(spark):
        runner.changes_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/s").awaitTermination()
    changes = runner.read_changes(spark, f"{tmp_path}/out", AGGREGATE)
    current = runner.latest(changes, ["sensor_id", "window_start_ts", "window_end_ts"])
    batch = window_agg(valid, DAY_MS)
    columns = [c for c in AGGREGATE.fieldNames() if c != "avg_amplitude"]
    assert as_set(current.select(columns)) == as_set(batch.select(columns))


@pytest.mark.parametrize("job", ["plain", "first seen", "last kept"])
def test_composed_jobs_in_one_query(spark, flushed, valid, tmp_path, job):
    readings, first_seen = read_stream(spark, flushed, 1), (20.0, 864_000_000)
    names = ["amplitude_threshold", "gap_ms", "ttl_ms"]
    if job == "plain":
        stream = jobs.filter_aggregate_stream(readings, "1 day", "1 hour")
        kept = valid
    elif job == "first seen":
        limits = dict(zip(names, first_seen))
        stream = jobs.first_seen_aggregate_stream(readings, "1 day", "1 hour", **limits)
        kept = dedup.dedup_first_seen(valid, *first_seen)
    else:
        limits = dict(zip(names, LAST_KEPT))
        stream = jobs.last_kept_aggregate_stream(readings, "1 day", "1 hour", **limits)
        kept = dedup.dedup_last_kept(valid, *LAST_KEPT)
    out, query = run(spark, stream, tmp_path, "out")
    batch = format_agg(window_agg(kept, DAY_MS), with_noise=job != "last kept").select("line")
    assert as_set(out.select("line")) == as_set(batch)
    assert runner.late_rows(query) == 0


def test_late_rows_are_counted(spark, flushed, slices, tmp_path):
    stream = window_agg_stream(read_stream(spark, flushed, 1), "1 day", "1 hour")
    run(spark, stream, tmp_path, "out")
    again = f"{tmp_path}/in"
    write(slices, again, [2, 3, 0])
    stream = window_agg_stream(read_stream(spark, again, 1), "1 day", "1 hour")
    _, query = run(spark, stream, tmp_path, "late")
    assert runner.late_rows(query) > 0


def test_restart_goes_on_where_it_stopped(spark, slices, valid, tmp_path):
    source = f"{tmp_path}/in"
    write(slices, source, [0, 1])
    for more in ([], [2, 3]):
        write(slices, source, more)
        stream = stateful.dedup_last_kept_stream(read_stream(spark, source, 1), *LAST_KEPT)
        out, _ = run(spark, stream, tmp_path, "out")
    assert as_set(out) == as_set(dedup.dedup_last_kept(valid, *LAST_KEPT))


def test_csv_files_roll(spark, folder, tmp_path):
    stream = window_agg_stream(read_stream(spark, folder, 1), "1 day", "1 hour")
    with runner.stream_settings(spark):
        writer = to_csv_files(stream, f"{tmp_path}/csv", f"{tmp_path}/s", None, max_records=50)
        writer.start().awaitTermination()
    back = spark.read.schema(AGGREGATE).csv(f"{tmp_path}/csv")
    per_file = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert len(per_file) > 10 and max(per_file) <= 50


def test_processing_time_counts_everything(spark, folder, valid):
    stream = window_agg_stream(read_stream(spark, folder), "1 second", time="processing")
    with runner.stream_settings(spark):
        query = to_memory(stream, "arrivals", "complete").trigger(availableNow=True).start()
        query.awaitTermination()
    assert spark.table("arrivals").agg(F.sum("total_count")).first()[0] == valid.count()


def test_progress_carries_stage_counts(spark, folder, valid, tmp_path):
    read = runner.observe_stage(read_stream(spark, folder), "read")
    stream = runner.observe_stage(read.where("phase_type = 'P'"), "p_waves")
    with runner.stream_settings(spark):
        query = runner.append_to_table(stream, f"{tmp_path}/o", f"{tmp_path}/s")
        query.awaitTermination()
    stages = runner.throughput(query)
    assert stages["input_records"] == stages["read_records"] == valid.count()
    assert stages["p_waves_records"] == valid.where("phase_type = 'P'").count()


CONSOLE = """
import sys
from pyspark.sql import functions as F
from tremora.session import local_session
from tremora.sinks.streams import to_console
from tremora.sources.readings import read_stream

spark = local_session("2", "console")
rows = read_stream(spark, sys.argv[1]).where("event_id < 15").select("event_id", "sensor_id")
to_console(rows).trigger(availableNow=True).start().awaitTermination()
"""


def test_console(valid, folder):
    """The JVM prints to its own standard output, so the job runs in a process of its own."""
    done = subprocess.run(
        [sys.executable, "-c", CONSOLE, folder], capture_output=True, text=True, timeout=300,
        env=os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))},
    )
    assert done.returncode == 0, done.stderr[-2000:]
    printed = re.findall(r"^\|\s*(\d+)\s*\|\s*(\S+)\s*\|$", done.stdout, re.M)
    expected = [(str(r.event_id), r.sensor_id) for r in valid.where("event_id < 15").collect()]
    assert "Batch: 0" in done.stdout and sorted(printed) == sorted(expected)
