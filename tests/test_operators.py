"""Hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tremora.operators import dedup, history, quality, ranking, scaling, spatial
from tremora.operators.windows import window_agg
from tremora.schemas import AGGREGATE, METRIC_SAMPLE, READING
from tremora.sinks.text import agg_to_csv, format_agg, format_record
from tremora.sources import metrics as metric_source
from tremora.sources.readings import read_bounded, read_readings


def reading(i, t=0, amp=10.0, sensor="sensor_1", lon=108.0, lat=34.0, phase="P", quality=1):
    return (i, sensor, t, lon, lat, 0, amp, 10, phase, quality, 5)


def frame(spark, rows):
    return spark.createDataFrame(rows, READING)


def kept_times(df):
    return sorted(r.collect_timestamp for r in df.collect())


def series(spark, points):
    return frame(spark, [reading(i, t, a) for i, (t, a) in enumerate(points)])


# --- filter -------------------------------------------------------------------------


def test_filter_bounds_are_inclusive(spark):
    good = [
        reading(1, amp=-100.0),
        reading(2, amp=200.0),
        reading(3, lon=73.0),
        reading(4, lon=135.0),
        reading(5, lat=3.0),
        reading(6, lat=53.0),
        reading(7, sensor="sensor_"),
    ]
    bad = [
        reading(11, amp=-100.01),
        reading(12, amp=200.01),
        reading(13, lon=72.999),
        reading(14, lon=135.001),
        reading(15, lat=2.999),
        reading(16, lat=53.001),
        reading(17, sensor="Sensor_1"),
        reading(18, sensor=None),
        reading(19, quality=0),
        reading(20, quality=2),
        reading(21, amp=None),
    ]
    df = frame(spark, good + bad)
    assert sorted(r.event_id for r in quality.filter_valid(df).collect()) == list(range(1, 8))
    report = {r.event_id: r.failed_rules for r in quality.reject_report(df).collect()}
    assert sorted(report) == list(range(11, 22))
    assert report[12] == ["amplitude"] and report[18] == ["sensor_id"]
    counts = quality.reject_counts(df).first()
    assert (counts.total, counts.rejected, counts.bad_sensor_id, counts.bad_amplitude) == (
        18,
        11,
        2,
        3,
    )


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "readings")
    frame(spark, [reading(1)]).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    df = window_agg(quality.filter_valid(read_readings(spark, path)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    for rule in [
        "EqualTo(data_quality,1)",
        "GreaterThanOrEqual(seismic_amplitude,-100.0)",
        "StringStartsWith(sensor_id,sensor_)",
        "LessThanOrEqual(longitude,135.0)",
        "GreaterThanOrEqual(latitude,3.0)",
    ]:
        assert rule in pushed
    assert "depth" not in pushed and "network_status" not in pushed


# --- windows ------------------------------------------------------------------------


def test_phase_counts_and_half_open_windows(spark):
    rows = [reading(i, t=1000 + i, phase=p) for i, p in enumerate(["P", "S", "N", "X", ""])]
    rows += [reading(9, t=2000, phase=None)]
    first, second = window_agg(frame(spark, rows)).orderBy("window_start_ts").collect()
    assert (first.p_phase_count, first.s_phase_count, first.n_phase_count) == (1, 1, 3)
    assert (first.window_start_ts, first.window_end_ts, first.total_count) == (1000, 2000, 5)
    assert (second.window_start_ts, second.n_phase_count) == (2000, 1)


def test_all_negative_window_reports_its_true_maximum(spark):
    row = window_agg(series(spark, [(0, -5.0), (1, -3.0)])).first()
    assert (row.max_amplitude, row.min_amplitude, row.avg_amplitude) == (-3.0, -5.0, -4.0)


def test_window_before_the_epoch(spark):
    row = window_agg(series(spark, [(-1, 1.0)])).first()
    assert (row.window_start_ts, row.window_end_ts) == (-1000, 0)


# --- history ------------------------------------------------------------------------


@pytest.fixture()
def ten_windows(spark):
    """Windows i = 0..9 with mean 20 + i and maximum 30 + i, then one more."""
    rows = [
        ("sensor_1", i * 1000, i * 1000 + 1000, 20.0 + i, 30.0 + i, 0.0, 1, 0, 0, 1)
        for i in range(10)
    ]
    rows.append(("sensor_1", 10_000, 11_000, 50.0, 50.0, 50.0, 1, 0, 0, 1))
    return spark.createDataFrame(rows, AGGREGATE)


def test_history_keeps_the_last_five(ten_windows):
    last = history.with_history(ten_windows, 5).orderBy(F.desc("window_start_ts")).first()
    assert last.history_avg == 27.0 and last.history_max == 39.0
    assert last.deviation == pytest.approx(23 / 27)


def test_first_window_has_no_history(ten_windows):
    first = history.with_history(ten_windows, 5).orderBy("window_start_ts").first()
    assert (first.history_avg, first.history_max, first.deviation) == (None, 0.0, 0.0)
    coverage = history.history_coverage(history.with_history(ten_windows, 5)).first()
    assert (coverage.windows, coverage.hits, coverage.misses) == (11, 10, 1)


def test_negative_history_gives_no_deviation(spark):
    rows = [("s", i * 1000, 0, -5.0, -1.0, 0.0, 1, 0, 0, 1) for i in range(2)]
    last = (
        history.with_history(spark.createDataFrame(rows, AGGREGATE))
        .orderBy(F.desc("window_start_ts"))
        .first()
    )
    assert (last.history_avg, last.history_max, last.deviation) == (-5.0, -1.0, 0.0)


def test_temporal_anomaly(spark, ten_windows):
    rows = series(spark, [(10_500, 50.0), (500, 50.0), (10_600, 27.0)])
    scored = history.score_temporal(rows, history.with_history(ten_windows, 5), 1000)
    result = {
        r.event_id: (r.temporal_ratio, r.anomaly)
        for r in scored.withColumn("anomaly", history.temporal_anomaly(0.3)).collect()
    }
    assert result[0] == (pytest.approx(50 / 27), True)
    assert result[1] == (1.0, False)  # no history counts as normal
    assert result[2] == (1.0, False)


def test_step_deviation_and_last_windows(ten_windows):
    steps = history.with_step_deviation(ten_windows).orderBy("window_start_ts").collect()
    assert steps[0].step_deviation is None
    assert steps[1].step_deviation == pytest.approx(1 / 20)
    newest = history.last_windows(ten_windows, 2).orderBy("age_rank").collect()
    assert [r.window_start_ts for r in newest] == [10_000, 9_000]


# --- dedup --------------------------------------------------------------------------


def test_last_kept_baseline_does_not_move_on_a_duplicate(spark):
    df = series(spark, [(0, 10.0), (50, 10.4), (90, 10.6), (120, 10.5), (300, 10.5)])
    assert kept_times(dedup.dedup_last_kept(df)) == [0, 90, 300]


def test_last_kept_baseline_ends_after_its_lifetime(spark):
    df = series(spark, [(0, 10.0), (59_950, 10.0), (59_990, 10.0), (60_010, 10.0)])
    assert kept_times(dedup.dedup_last_kept(df)) == [0, 59_950, 60_010]


def test_threshold_is_a_float_difference(spark):
    # 10.5 - 10 is exactly 0.5: not smaller. 0.3 - 0.2 as floats is 0.10000001.
    assert kept_times(dedup.dedup_last_kept(series(spark, [(0, 10.0), (1, 10.5)]))) == [0, 1]
    assert kept_times(dedup.dedup_last_kept(series(spark, [(0, 0.2), (1, 0.3)]), 0.1)) == [0, 1]


def test_dedup_can_be_switched_off(spark):
    df = series(spark, [(0, 10.0), (1, 10.0)])
    assert kept_times(dedup.dedup_last_kept(df, enabled=False)) == [0, 1]


def test_first_seen(spark):
    df = series(spark, [(0, 10.0), (400, 10.0), (600, 10.0), (700, 10.0)])
    assert kept_times(dedup.dedup_first_seen(df)) == [0, 600, 700]


def test_first_seen_breaks_ties_by_id(spark):
    df = frame(spark, [reading(2, 0, 10.0), reading(1, 0, 50.0), reading(3, 5, 50.0)])
    kept = sorted(r.event_id for r in dedup.dedup_first_seen(df).collect())
    assert kept == [1, 2]


def test_dedup_stats(spark):
    df = series(spark, [(0, 10.0), (50, 10.4), (90, 10.6), (120, 10.5)])
    rows = {r.sensor_id: r for r in dedup.dedup_stats(dedup.flag_last_kept(df)).collect()}
    total = rows[None]
    assert (total.input_count, total.output_count, total.skipped_count) == (4, 2, 2)
    assert total.skip_percent == 50.0 and rows["sensor_1"].skipped_count == 2


def test_change_info(spark):
    first, second = (
        dedup.with_change_info(series(spark, [(0, 10.0), (70, 7.5)]))
        .orderBy("collect_timestamp")
        .collect()
    )
    assert (first.has_previous, first.amplitude_change, first.time_diff) == (False, None, None)
    assert (second.has_previous, second.amplitude_change, second.time_diff) == (True, -2.5, 70)
    assert second.previous_amplitude == 10.0


def test_active_sensors(spark):
    df = frame(spark, [reading(1, 0, sensor="sensor_a"), reading(2, 40_001, sensor="sensor_b")])
    at = {r.sensor_id for r in ranking.active_sensors(df, 100_001).collect()}
    assert at == {"sensor_b"}
    assert ranking.active_sensors(df, 60_000).count() == 2


# --- spatial ------------------------------------------------------------------------


def test_cell_of_negative_coordinates(spark):
    row = spatial.with_grid(frame(spark, [reading(1, lon=-0.005, lat=0.005)])).first()
    assert (row.gx, row.gy, row.grid_key) == (-1, 0, "GRID_-1_0")


def test_neighbour_keys(spark):
    cells = spark.createDataFrame([(0, 0)], "gx bigint, gy bigint")
    keys = {r.neighbour_key for r in spatial.neighbour_keys(cells, 1).collect()}
    assert len(keys) == 8 and "GRID_0_0" not in keys and "GRID_-1_1" in keys
    assert spatial.neighbour_keys(cells, 2).count() == 24


@pytest.fixture(scope="module")
def square(spark, data_dir):
    """A hundred readings in a 0.05 degree square, taken from the event table."""
    events = spark.read.parquet(f"{data_dir}/events.parquet").where("event_id < 100")
    rows = [
        reading(
            r.event_id,
            r.event_id,
            r.value,
            lon=108.0 + (r.user_id * 37 % 50) / 1000,
            lat=34.0 + (r.user_id * 91 % 50) / 1000,
        )
        for r in events.collect()
    ]
    return frame(spark, rows)


def test_neighbourhood_against_brute_force(square):
    rows = spatial.with_cell(square).collect()
    result = {
        (r.gx, r.gy): r
        for r in spatial.neighbourhood_agg(spatial.grid_agg(square)).collect()
    }
    assert set(result) == {(r.gx, r.gy) for r in rows}
    for (x, y), row in result.items():
        near = [r for r in rows if abs(r.gx - x) <= 1 and abs(r.gy - y) <= 1]
        assert row.record_count == len(near)
        mean = sum(r.seismic_amplitude for r in near) / len(near)
        assert row.avg_amplitude == pytest.approx(mean)


def test_running_scores_against_brute_force(square):
    rows = sorted(spatial.with_cell(square).collect(), key=lambda r: r.event_id)
    scored = spatial.score_spatial(square).withColumns(
        {"spatial": spatial.spatial_anomaly(0.5), "regional": spatial.regional_anomaly(0.5)}
    )
    result = {r.event_id: r for r in scored.collect()}
    for i, r in enumerate(rows):
        near = [
            q.seismic_amplitude
            for q in rows[: i + 1]
            if abs(q.gx - r.gx) <= 1 and abs(q.gy - r.gy) <= 1
        ]
        mean = sum(near) / len(near)
        got = result[r.event_id]
        assert got.neighbourhood_avg == pytest.approx(mean)
        assert got.spatial == (mean > 0 and r.seismic_amplitude / mean > 1.5)
        rest = mean - r.seismic_amplitude
        if abs(rest) > 1e-9:
            assert got.regional == (r.seismic_amplitude / rest > 1.5)


def test_a_lone_reading_is_no_regional_anomaly(spark):
    scored = spatial.score_spatial(series(spark, [(0, 10.0)]))
    row = scored.withColumn("regional", spatial.regional_anomaly()).first()
    assert (row.neighbourhood_avg, row.spatial_ratio, row.regional) == (10.0, 1.0, False)


def test_merge_of_daily_grids_is_the_whole(square):
    early, late = square.where("event_id < 40"), square.where("event_id >= 40")
    merged = spatial.merge_grids(spatial.grid_agg(early).unionByName(spatial.grid_agg(late)))
    whole = spatial.grid_agg(square)
    left = {r.grid_key: r for r in merged.collect()}
    for row in whole.collect():
        assert left[row.grid_key].record_count == row.record_count
        assert left[row.grid_key].sum_amplitude == pytest.approx(row.sum_amplitude)
        assert left[row.grid_key].last_update == row.last_update


# --- ranking ------------------------------------------------------------------------


def test_kth_access(spark):
    log = spark.createDataFrame(
        [("a", 10), ("a", 20), ("a", 30), ("b", 10), ("c", 5), ("c", 5)],
        "sensor_id string, collect_timestamp bigint",
    )
    assert {r.sensor_id: r.kth_access for r in ranking.kth_access(log).collect()} == {
        "a": 20,
        "b": 0,
        "c": 5,
    }
    assert [r.sensor_id for r in ranking.coldest(log, n=2).collect()] == ["b", "c"]
    assert [r.sensor_id for r in ranking.hottest(log, n=1).collect()] == ["a"]


def test_frequencies(spark):
    log = spark.createDataFrame(
        [("a", t) for t in (0, 1000, 2000, 3000)], "sensor_id string, collect_timestamp bigint"
    )
    decayed = ranking.decayed_frequency(log, 5000, 0.95).first()
    assert decayed.decayed_frequency == pytest.approx(3.61)
    assert ranking.access_frequency(log, 5000).first().frequency == pytest.approx(0.8)
    assert ranking.access_frequency(log, 0).first().frequency == 4.0


def test_hot_sensors_hold_most_readings(spark):
    """Four of five readings on 100 of 500 sensors: ranking by count finds them."""
    log = spark.range(100_000).selectExpr(
        "concat('sensor_', lpad(CAST(CASE WHEN id % 5 < 4 THEN id % 100"
        " ELSE 100 + id % 400 END AS STRING), 4, '0')) AS sensor_id",
        "id AS collect_timestamp",
    )
    counts = ranking.access_frequency(log, 0)
    top = counts.orderBy(F.desc("access_count"), "sensor_id").limit(100)
    share = top.agg(F.sum("access_count")).first()[0] / 100_000
    assert share == pytest.approx(0.8, abs=0.05)


# --- scaling ------------------------------------------------------------------------


def test_counter_rate(spark):
    samples = spark.createDataFrame(
        [("j", 0, 100, 1), ("j", 10, 150, 2), ("j", 20, 140, 3), ("j", 20, 140, 4), ("j", 27, 170, 5)],
        "job_id string, ts bigint, total_records bigint, sample_id bigint",
    )
    rated = scaling.counter_rate(samples, order=("ts", "sample_id"))
    assert [r.rate for r in rated.orderBy("sample_id").collect()] == [0, 5, 0, 0, 4]


def test_mean_load_is_cut_not_rounded(spark):
    loads = spark.createDataFrame(
        [(0, 0.1), (0, 0.2), (0, 0.2), (1, 0.29), (1, 0.28), (2, None), (3, 0.2), (3, None)],
        "ts bigint, cpu double",
    )
    assert {r.ts: (r.cpu, r.nodes) for r in scaling.mean_load(loads).collect()} == {
        0: (0.1666, 3),
        1: (0.285, 2),
        2: (0.0, 1),
        3: (0.1, 2),
    }


@pytest.mark.parametrize(
    "values,fires",
    [([3001, 3001, 3001], True), ([3001, 3001], False), ([3001, 3000, 3001], False)],
)
def test_debounce(spark, values, fires):
    rows = [("j", 10 * i, v, 0.6) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, METRIC_SAMPLE)
    flagged = scaling.sustained(df, {"high": F.col("throughput") > 3000}, 50)
    assert flagged.orderBy(F.desc("ts")).first().high is fires


def test_debounce_span_includes_both_ends(spark):
    rows = [("j", t, 3001 if t else 0, 0.6) for t in (0, 1, 25, 50, 51)]
    df = spark.createDataFrame(rows, METRIC_SAMPLE)
    flags = scaling.sustained(df, {"high": F.col("throughput") > 3000}, 50)
    assert {r.ts: r.high for r in flags.collect()} == {
        0: False,
        1: False,
        25: False,
        50: False,
        51: True,
    }


def recommendation(spark, rate, cpu, parallelism, workers):
    rows = [("j", 10 * i, rate, cpu) for i in range(3)]
    df = spark.createDataFrame(rows, METRIC_SAMPLE).withColumns(
        {"parallelism": F.lit(parallelism), "worker_count": F.lit(workers)}
    )
    return scaling.recommend(df).orderBy(F.desc("ts")).first()


@pytest.mark.parametrize(
    "rate,cpu,parallelism,workers,rule,action,target_p,target_w",
    [
        (3001, 0.6, 4, 4, "rate_high", "parallelism_up", 6, 4),
        (3001, 0.6, 11, 4, "rate_high", "parallelism_up", 12, 4),
        (3001, 0.3, 12, 4, "cpu_low", "worker_down", 12, 3),  # falls through at the bound
        (799, 0.6, 4, 4, "rate_low", "parallelism_down", 3, 4),
        (799, 0.9, 3, 4, "cpu_high", "worker_up", 3, 5),
        (1000, 0.9, 4, 6, "cpu_high", "none", 4, 6),  # matches at the bound, does nothing
        (1000, 0.3, 4, 3, "cpu_low", "none", 4, 3),
        (1000, 0.6, 4, 4, "none", "none", 4, 4),
    ],
)
def test_recommendation(
    spark, rate, cpu, parallelism, workers, rule, action, target_p, target_w
):
    row = recommendation(spark, rate, cpu, parallelism, workers)
    assert (row.rule, row.action, row.target_parallelism, row.target_workers) == (
        rule,
        action,
        target_p,
        target_w,
    )


# A recorded metrics log.
RECORDED = """\
1764923987,throughput:2418,cpu:0.0152
1764923997,throughput:2461,cpu:0.0190
1764924008,throughput:2328,cpu:0.0157
1764924018,throughput:2287,cpu:0.0175
1764924029,throughput:2081,cpu:0.0216
1764924039,throughput:1875,cpu:0.0198
1764924049,throughput:2411,cpu:0.0162
1764924060,throughput:2152,cpu:0.0198
1765164042,throughput:0,cpu:0.0353
1765164053,throughput:0,cpu:0.0229
1765164063,throughput:0,cpu:0.0240
1765164325,throughput:3,cpu:0.0199
1765164336,throughput:0,cpu:0.0171
1765164346,throughput:0,cpu:0.0123
1765164356,throughput:0,cpu:0.0130
1765164367,throughput:0,cpu:0.0139
1765164377,throughput:0,cpu:0.0138
1765166425,throughput:3,cpu:0.0130
1765166436,throughput:0,cpu:0.0120
1765166446,throughput:0,cpu:0.0112
1765166585,throughput:2,cpu:0.0122
1765166610,throughput:13,cpu:0.0119
1765166620,throughput:0,cpu:0.0114
1765166631,throughput:0,cpu:0.0109
1765166916,throughput:3,cpu:0.0126
1765166926,throughput:0,cpu:0.0119
1765167916,throughput:3,cpu:0.0458
1765167926,throughput:24,cpu:0.0438
1765167937,throughput:158,cpu:0.0494
1765245250,throughput:0,cpu:0.1865
1765245260,throughput:999,cpu:0.1183
1765245271,throughput:898,cpu:0.0983
1765245281,throughput:985,cpu:0.1033
1765245291,throughput:984,cpu:0.0901
1765245302,throughput:901,cpu:0.0761
"""


@pytest.fixture()
def recorded(spark, tmp_path):
    path = tmp_path / "history.log"
    path.write_text(RECORDED + "not a sample\n")
    # In the middle of the allowed range, so that no bound is reached.
    return metric_source.read_metrics_log(spark, str(path), "job").withColumns(
        {"parallelism": F.lit(6), "worker_count": F.lit(5)}
    )


@pytest.mark.parametrize(
    "policy,expected",
    [
        (scaling.PRODUCTION, {"none": 16, "parallelism_down": 9, "worker_down": 10}),
        (
            scaling.DOCUMENTED,
            {"none": 17, "parallelism_up": 6, "parallelism_down": 8, "worker_down": 4},
        ),
    ],
)
def test_recorded_log(recorded, policy, expected):
    assert recorded.count() == 35
    actions = scaling.recommend(recorded, policy).groupBy("action").count().collect()
    assert {r.action: r["count"] for r in actions} == expected


def test_retention_keeps_the_bound(recorded):
    now = 1765164042 + 7 * 86_400
    assert scaling.retain(recorded, now).count() == 27


# --- text and bounded read ----------------------------------------------------------


def test_lines(spark):
    record = format_record(series(spark, [(0, 10.126)])).first()
    assert record.line == "sensorId=sensor_1 | amplitude=10.13 | quality=1"
    agg = window_agg(series(spark, [(0, 10.0), (1, 20.5)]))
    line = "sensorId=sensor_1 | window=[0, 1000) | avg=15.25 | max=20.50 | P=2 | S=0"
    assert format_agg(agg).first().line == line + " | N=0"
    assert format_agg(agg, with_noise=False).first().line == line
    assert agg_to_csv(agg).first().csv == "sensor_1,0,1000,15.25,20.5,10.0,2,0,0"


def test_read_bounded(spark):
    df = series(spark, [(t, 1.0) for t in (5, 3, 9, 1)])
    assert kept_times(read_bounded(df, 2)) == [1, 3]
