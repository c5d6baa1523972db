"""Streams with history, alerts, silence, progress and tables of their own, against batch forms."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_streams import LAST_KEPT, as_set, folder, flushed, run, slices, valid, write  # noqa: F401

from tremora.operators import dedup, history, ranking, scaling, spatial
from tremora.operators.windows import DAY_MS, window_agg
from tremora.schemas import PAYLOAD
from tremora.sources import events, payloads
from tremora.sources.readings import read_stream
from tremora.streaming import activity, alerts, jobs, progress, runner, stateful, tables

KEYS = ["k"]
ROW = T.StructType().add("k", "long").add("v", "long").add("w", "string")


def test_history_in_the_same_query_over_a_restart(spark, slices, valid, tmp_path):  # noqa: F811
    from tremora.plans import registry

    source, names = f"{tmp_path}/in", ["amplitude_threshold", "gap_ms", "ttl_ms"]
    for which in ([0, 1], [2, 3]):
        write(slices, source, which)
        if which == [2, 3]:
            registry._flush(spark).coalesce(1).write.mode("append").parquet(source)
        limits = dict(zip(names, LAST_KEPT))
        stream = jobs.last_kept_history_stream(read_stream(spark, source, 1), "1 day", "1 hour", 10, **limits)
        out, _ = run(spark, stream, tmp_path, "out")
    batch = history.with_history(window_agg(dedup.dedup_last_kept(valid, *LAST_KEPT), DAY_MS), 10)
    keys, columns = ["sensor_id", "window_start_ts"], ["history_avg", "history_max", "deviation"]
    got = {tuple(r[k] for k in keys): [r[c] for c in columns] for r in out.collect()}
    expected = {tuple(r[k] for k in keys): [r[c] for c in columns] for r in batch.collect()}
    assert got.keys() == expected.keys() and out.count() == len(got)
    for key, values in expected.items():
        for a, b in zip(got[key], values):
            assert a == b if a is None or b is None else a == pytest.approx(b, abs=1e-9)


def test_spatial_blocks_send_few_copies(spark, folder, valid, tmp_path):  # noqa: F811
    sent = spatial.sent_to_blocks(valid, 0.01, 1).count()
    assert sent < 2.5 * valid.count()
    for radius in (1, 2):
        stream = stateful.score_spatial_stream(read_stream(spark, folder, 1), 0.01, radius)
        out, query = run(spark, stream, tmp_path, f"out{radius}")
        got = {r.event_id: r.neighbourhood_avg for r in out.collect()}
        expected = {r.event_id: r.neighbourhood_avg for r in spatial.score_spatial(valid, 0.01, radius).collect()}
        assert got.keys() == expected.keys()
        assert all(got[k] == pytest.approx(expected[k], abs=1e-9) for k in got)


@pytest.mark.parametrize("files", [1, 3])
def test_alerts_of_arriving_logs(spark, tmp_path, files):
    random_ = random.Random(files)
    samples = []
    for job in ("a", "b"):
        ts = 1_000_000
        for _ in range(300):
            ts += random_.choice([0, 5, 10, 10, 10, 200])
            level = 4000 if ts // 700 % 3 == 0 else 2000 if ts // 700 % 3 == 1 else 100
            samples.append((job, ts, level, random_.choice([0.2, 0.9])))
    schema = "job_id string, ts long, throughput long, cpu double"
    df = spark.createDataFrame(samples, schema).withColumns({"parallelism": F.lit(6), "worker_count": F.lit(4)})
    policy = scaling.PRODUCTION
    batch = scaling.alerts(scaling.recommend(scaling.retain(df, 1_000_000), policy))
    seconds = sorted({s[1] for s in samples})
    for k in range(files):  # whole seconds, in order
        lo, hi = seconds[k * len(seconds) // files], ([*seconds, 1 << 40])[(k + 1) * len(seconds) // files]
        lines = df.where((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1)
        lines = lines.select("job_id", F.format_string("%d,throughput:%d,cpu:%.4f", "ts", "throughput", "cpu"))
        odd = spark.createDataFrame([("a", "no sample"), ("b", "1,throughput:x")], "job_id string, line string")
        lines.union(odd).coalesce(1).write.mode("append").partitionBy("job_id").text(f"{tmp_path}/in")
    logged = alerts.read_job_logs_stream(spark, f"{tmp_path}/in").withColumns(
        {"parallelism": F.lit(6), "worker_count": F.lit(4)}
    )
    out, _ = run(spark, alerts.scaling_alerts_stream(logged, 1_000_000, policy, delay="10 days"), tmp_path, "out")
    columns = ["job_id", "ts", "rule", "alert"]
    assert batch.count() > 20 and as_set(out.select(columns)) == as_set(batch.select(columns))


def test_silence_is_told_and_taken_back(spark, flushed, valid, tmp_path):  # noqa: F811
    ttl = 21_600_000
    stream = activity.activity_stream(read_stream(spark, flushed, 1), ttl, "1 hour")
    changes, _ = run(spark, stream, tmp_path, "out")
    for at in (1_704_844_800_000, 1_705_708_800_000, 1_706_400_000_000):
        expected = ranking.active_sensors(valid, at, ttl).select("sensor_id")
        assert as_set(activity.active_at(changes, at)) == as_set(expected)
    rows: dict = {}
    for r in changes.where("sensor_id NOT LIKE '%flush'").orderBy("since").collect():
        rows.setdefault(r.sensor_id, []).append((r.since, r.is_active))
    for told in rows.values():  # in turn, and silent at the end
        assert [x[1] for x in told] == [i % 2 == 0 for i in range(len(told))] and not told[-1][1]


def test_progress_is_kept_for_every_batch(spark, folder, valid, tmp_path):  # noqa: F811
    log = progress.ProgressLog(spark, f"{tmp_path}/progress")
    spark.streams.addListener(log)
    try:
        read = runner.observe_stage(read_stream(spark, folder, 1), "read")
        stream = runner.observe_stage(read.where("phase_type = 'P'"), "p_waves")
        run(spark, stream, tmp_path, "out")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(log)
    rows = progress.read_progress(spark, f"{tmp_path}/progress")
    assert rows.count() >= 4 and rows.where("processed_per_second > 0").count() == rows.count()
    totals = {r.stage: (r.records, r.batches) for r in progress.stage_totals(rows).collect()}
    assert totals["input"][0] == totals["read"][0] == valid.count() and totals["read"][1] >= 4
    assert totals["p_waves"][0] == valid.where("phase_type = 'P'").count()
    again = rows.withColumns({"ended_at": F.lit("9"), "run_id": F.lit("later")}).unionByName(rows)
    assert {r.stage: (r.records, r.batches) for r in progress.stage_totals(again).collect()} == totals


def changed(spark, batch_id):
    return spark.createDataFrame([(k, batch_id * 10 + k, f"b{batch_id}") for k in range(batch_id % 7 + 1)], ROW)


def test_change_log_of_many_batches(spark, tmp_path):
    path, every = f"{tmp_path}/log", 20
    write_batch = tables.write_changes(path, ROW, KEYS, every)
    newest = {}
    for batch_id in range(70):
        write_batch(changed(spark, batch_id), batch_id)
        newest |= {k: (k, batch_id * 10 + k, f"b{batch_id}") for k in range(batch_id % 7 + 1)}
    current = tables.read_current(spark, path, ROW, KEYS)
    assert current.columns == ROW.fieldNames() and sorted(map(tuple, current.collect())) == sorted(newest.values())
    bases, batches = tables.base_folders(spark, path), tables.batch_folders(spark, path)
    assert max(bases) == 59 and len(bases) <= 2 and len(batches) <= 2 * every
    # A batch that a base holds is not written again, and a reader of before still finds its files.
    write_batch(changed(spark, 3), 3)
    assert 3 not in tables.batch_folders(spark, path)
    tables.compact(spark, path, ROW, KEYS)
    assert sorted(map(tuple, current.collect())) == sorted(newest.values())
    assert tables.compact(spark, path, ROW, KEYS) is None
    assert tables.read_current(spark, f"{tmp_path}/none", ROW, KEYS).count() == 0


def test_unfinished_folders_do_not_count(spark, tmp_path):
    path = f"{tmp_path}/log"
    for batch_id in range(3):
        tables.write_changes(path, ROW, KEYS, 100)(changed(spark, batch_id), batch_id)
    changed(spark, 6).write.parquet(f"{path}/_base/upto=9")
    changed(spark, 6).write.parquet(f"{path}/batch_id=7")
    for place in ("_base/upto=9", "batch_id=7"):
        (tmp_path / "log" / place / "_SUCCESS").unlink()
    found = sorted(map(tuple, tables.read_current(spark, path, ROW, KEYS).collect()))
    assert found == [(0, 20, "b2"), (1, 21, "b2"), (2, 22, "b2")]


def test_payloads_to_two_tables_over_a_failure(spark, data_dir, tmp_path):
    encoded = events.payloads(spark, data_dir).where("event_id < 2000")
    for k in range(3):
        encoded.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def start():
        decoded = payloads.decode_payloads(read_stream(spark, f"{tmp_path}/in", 1, PAYLOAD))
        places = (f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/state")
        return decoded, tables.decoded_to_tables(decoded, *places)

    # A batch that failed between its two tables: one folder is there, the checkpoint has no commit.
    changed(spark, 2).write.parquet(f"{tmp_path}/good/batch_id=1")
    decoded, query = start()
    query.awaitTermination()
    (tmp_path / "state" / "commits" / "2").unlink()  # as if it had stopped before the last commit
    for crc in (tmp_path / "state" / "commits").glob(".2.crc"):
        crc.unlink()
    decoded, query = start()
    query.awaitTermination()
    good, bad = (
        tables.read_batches(spark, f"{tmp_path}/{name}", part.schema)
        for name, part in zip(("good", "bad"), payloads.split_decoded(decoded))
    )
    expected = payloads.split_decoded(payloads.decode_payloads(encoded))
    assert as_set(good) == as_set(expected[0]) and as_set(bad.drop("decode_error")) == as_set(expected[1].drop("decode_error"))


@pytest.mark.parametrize("radius", [1, 3, 10])
def test_neighbourhoods_of_any_radius(spark, radius):
    random_ = random.Random(radius)
    cells = {(random_.randrange(-9, 30), random_.randrange(0, 25)) for _ in range(200)}
    rows = [(x, y, f"GRID_{x}_{y}", n, n * 2.5, float(n), -float(n), n % 3, n % 2, 0.0, n * 7) for n, (x, y) in enumerate(cells, 1)]
    names = ["gx", "gy", "grid_key", "record_count", "sum_amplitude", "max_amplitude", "min_amplitude"]
    names += ["p_wave_count", "s_wave_count", "avg_amplitude", "last_update"]
    grids = spark.createDataFrame(rows, names)
    found = {(r.gx, r.gy): r for r in spatial.neighbourhood_agg(grids, radius).collect()}
    assert found.keys() == cells
    for (x, y), r in found.items():
        near = [row for row in rows if abs(row[0] - x) <= radius and abs(row[1] - y) <= radius]
        assert r.record_count == sum(row[3] for row in near) and r.p_wave_count == sum(row[7] for row in near)
        assert r.sum_amplitude == pytest.approx(sum(row[4] for row in near))
        assert (r.max_amplitude, r.min_amplitude) == (max(row[5] for row in near), min(row[6] for row in near))
        assert r.last_update == max(row[10] for row in near) and r.grid_key == f"GRID_{x}_{y}"


def test_progress_rows_are_plain_json(tmp_path):
    assert progress._finite(float("nan")) is None and progress._finite(float("inf")) is None
    assert json.dumps(progress._finite(2.0)) == "2.0"
