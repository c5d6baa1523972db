"""Independent SQL (DuckDB dialect) for the registered queries, over whole tables."""

from __future__ import annotations

DAY = 86_400_000

# Milliseconds are cut from microseconds, as Spark does; DuckDB's epoch_ms may round.
READINGS = """readings AS (
  SELECT event_id,
    concat(CASE WHEN user_id % 29 = 0 THEN 'probe_' ELSE 'sensor_' END,
           lpad(CAST(user_id AS VARCHAR), 4, '0'), '_region_',
           CAST(user_id % 5 AS VARCHAR)) AS sensor_id,
    epoch_us(ts) // 1000 AS collect_timestamp,
    CASE WHEN event_id % 97 = 0 THEN CAST(140.0 AS DOUBLE)
         ELSE CAST(108.0 AS DOUBLE) + user_id * CAST(0.001 AS DOUBLE) END AS longitude,
    CASE WHEN event_id % 89 = 0 THEN CAST(60.0 AS DOUBLE)
         ELSE CAST(34.0 AS DOUBLE) + user_id * CAST(0.001 AS DOUBLE) END AS latitude,
    CAST(CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 50 ELSE 100 END
         AS INTEGER) AS depth,
    CAST(CASE WHEN event_id % 7 = 0 THEN -value ELSE value END AS FLOAT)
      AS seismic_amplitude,
    10 AS frequency,
    CASE event_type WHEN 'click' THEN 'P' WHEN 'view' THEN 'S'
                    WHEN 'signup' THEN 'X' ELSE 'N' END AS phase_type,
    CASE WHEN event_id % 20 = 3 THEN 0 ELSE 1 END AS data_quality,
    5 AS network_status
  FROM events)"""

RULES = {
    "quality": "data_quality = 1",
    "amplitude": "seismic_amplitude BETWEEN -100 AND 200",
    "sensor_id": "sensor_id IS NOT NULL AND starts_with(sensor_id, 'sensor_')",
    "longitude": "longitude BETWEEN 73 AND 135",
    "latitude": "latitude BETWEEN 3 AND 53",
}
IS_VALID = " AND ".join(f"({r})" for r in RULES.values())
VALID = f"valid AS (SELECT * FROM readings WHERE {IS_VALID})"


def _aggregate(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT sensor_id, window_start_ts, window_start_ts + {DAY} AS window_end_ts,
    avg(CAST(seismic_amplitude AS DOUBLE)) AS avg_amplitude,
    max(seismic_amplitude) AS max_amplitude, min(seismic_amplitude) AS min_amplitude,
    count(*) FILTER (WHERE phase_type = 'P') AS p_phase_count,
    count(*) FILTER (WHERE phase_type = 'S') AS s_phase_count,
    count(*) FILTER (WHERE phase_type NOT IN ('P', 'S')) AS n_phase_count,
    count(*) AS total_count
  FROM (SELECT *, collect_timestamp - collect_timestamp % {DAY} AS window_start_ts FROM {source})
  GROUP BY sensor_id, window_start_ts)"""


def _history(source: str) -> str:
    return f"""history AS (
  SELECT *,
    avg(avg_amplitude) OVER w AS history_avg,
    coalesce(max(max_amplitude) OVER w, CAST(0 AS FLOAT)) AS history_max,
    lag(avg_amplitude) OVER (PARTITION BY sensor_id ORDER BY window_start_ts) AS previous_avg
  FROM {source}
  WINDOW w AS (PARTITION BY sensor_id ORDER BY window_start_ts
               ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"""


AGG = _aggregate("agg", "valid")
HISTORY = _history("agg")
TEMPORAL = f"""temporal AS (
  SELECT v.*, h.history_avg,
    CASE WHEN h.history_avg IS NULL OR h.history_avg = 0 THEN 1.0
         ELSE CAST(v.seismic_amplitude AS DOUBLE) / h.history_avg END AS temporal_ratio
  FROM valid v LEFT JOIN history h ON h.sensor_id = v.sensor_id
   AND h.window_start_ts = v.collect_timestamp - v.collect_timestamp % {DAY})"""
CELLED = """celled AS (
  SELECT *, CAST(floor(longitude / 0.01) AS BIGINT) AS gx,
            CAST(floor(latitude / 0.01) AS BIGINT) AS gy FROM valid)"""


def _grid(name: str, extra: str = "") -> str:
    return f"""{name} AS (
  SELECT {extra} gx, gy, concat('GRID_', gx, '_', gy) AS grid_key,
    count(*) AS record_count, sum(CAST(seismic_amplitude AS DOUBLE)) AS sum_amplitude,
    max(CAST(seismic_amplitude AS DOUBLE)) AS max_amplitude,
    min(CAST(seismic_amplitude AS DOUBLE)) AS min_amplitude,
    count(*) FILTER (WHERE phase_type = 'P') AS p_wave_count,
    count(*) FILTER (WHERE phase_type = 'S') AS s_wave_count,
    max(collect_timestamp) AS last_update
  FROM celled GROUP BY {extra} gx, gy)"""


GRID = _grid("grid")
GRID_COLUMNS = """gx, gy, grid_key, record_count, round(sum_amplitude, 6) AS sum_amplitude,
  max_amplitude, min_amplitude, round(sum_amplitude / record_count, 6) AS avg_amplitude,
  p_wave_count, s_wave_count, last_update"""


def _spatial(source: str) -> str:
    return f"""spatial AS (
  SELECT a.event_id, a.sensor_id, a.collect_timestamp, a.seismic_amplitude,
    sum(CAST(b.seismic_amplitude AS DOUBLE)) / count(*) AS neighbourhood_avg
  FROM {source} a JOIN {source} b
    ON b.gx BETWEEN a.gx - 1 AND a.gx + 1 AND b.gy BETWEEN a.gy - 1 AND a.gy + 1
   AND (b.collect_timestamp < a.collect_timestamp
        OR (b.collect_timestamp = a.collect_timestamp AND b.event_id <= a.event_id))
  GROUP BY ALL),
scores AS (SELECT *, CASE WHEN neighbourhood_avg > 0
    THEN CAST(seismic_amplitude AS DOUBLE) / neighbourhood_avg ELSE 0.0 END AS spatial_ratio
  FROM spatial)"""


SPATIAL = _spatial("celled")
SCORE_COLUMNS = """event_id, sensor_id, collect_timestamp, seismic_amplitude,
  round(neighbourhood_avg, 6) AS neighbourhood_avg, round(spatial_ratio, 6) AS spatial_ratio"""

# amplitude < 20, gap < 6 h, baseline lifetime 10 days
DUP = """r.collect_timestamp - f.created <= 864000000
      AND CAST(abs(r.seismic_amplitude - f.base_amp) AS DOUBLE) < 20.0
      AND r.collect_timestamp - f.base_ts < 21600000"""
LAST_KEPT = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY collect_timestamp, event_id) AS rn
  FROM valid),
folded AS (
  SELECT sensor_id, rn, seismic_amplitude AS base_amp, collect_timestamp AS base_ts,
         collect_timestamp AS created, false AS is_duplicate
  FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.sensor_id, r.rn,
    CASE WHEN {DUP} THEN f.base_amp ELSE r.seismic_amplitude END,
    CASE WHEN {DUP} THEN f.base_ts ELSE r.collect_timestamp END,
    CASE WHEN r.collect_timestamp - f.created > 864000000 THEN r.collect_timestamp
         ELSE f.created END,
    {DUP}
  FROM folded f JOIN ranked r ON r.sensor_id = f.sensor_id AND r.rn = f.rn + 1),
flagged AS (
  SELECT r.*, f.is_duplicate FROM ranked r JOIN folded f
    ON f.sensor_id = r.sensor_id AND f.rn = r.rn),
kept AS (SELECT * EXCLUDE (rn, is_duplicate) FROM flagged WHERE NOT is_duplicate)"""
# The defaults, amplitude < 0.5, gap < 100 ms, lifetime 60 s, over denser readings.
DENSE = """dense AS (SELECT * REPLACE (collect_timestamp // 360000 AS collect_timestamp,
  CAST(CAST(seismic_amplitude AS DOUBLE) / 64 AS FLOAT) AS seismic_amplitude) FROM valid)"""
KEPT_BY_DEFAULT = LAST_KEPT
for wide, default in (("864000000", "60000"), ("20.0", "0.5"), ("21600000", "100"), ("FROM valid", "FROM dense")):
    KEPT_BY_DEFAULT = KEPT_BY_DEFAULT.replace(wide, default)
# amplitude < 20, gap < 10 days
FIRST_SEEN = """firsts AS (
  SELECT *, first_value(seismic_amplitude) OVER w AS first_amp,
    first_value(collect_timestamp) OVER w AS first_ts, row_number() OVER w AS rn
  FROM valid WINDOW w AS (PARTITION BY sensor_id ORDER BY collect_timestamp, event_id)),
kept AS (SELECT * EXCLUDE (first_amp, first_ts, rn) FROM firsts
  WHERE rn = 1 OR NOT (CAST(abs(seismic_amplitude - first_amp) AS DOUBLE) < 20.0
                       AND abs(collect_timestamp - first_ts) < 864000000))"""

METRICS = """metrics AS (
  SELECT event_id AS sample_id, concat('job_', user_id % 16) AS job_id, t AS ts,
    ((t // 43200) % 4) * 1200 + CAST(floor(value) AS BIGINT) AS throughput,
    ((t // 28800) % 5) * CAST(0.21 AS DOUBLE)
      + (event_id % 100) / CAST(10000 AS DOUBLE) AS cpu,
    CAST(3 + t // 86400 % 10 AS INTEGER) AS parallelism,
    CAST(3 + t // 86400 % 4 AS INTEGER) AS worker_count
  FROM (SELECT *, epoch_us(ts) // 1000000 AS t FROM events))"""
HELD = {
    "rate_high": "throughput > 3000",
    "rate_low": "throughput < 800",
    "cpu_high": "cpu > 0.8",
    "cpu_low": "cpu < 0.5",
}


def _sustained(source: str) -> str:
    flags = ", ".join(
        f"(count(*) OVER w >= 3 AND bool_and({rule}) OVER w) AS {name}"
        for name, rule in HELD.items()
    )
    return f"""sustained AS (SELECT *, {flags} FROM {source}
  WINDOW w AS (PARTITION BY job_id ORDER BY ts RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW))"""


SUSTAINED = _sustained("metrics")
RECOMMENDED = """ruled AS (
  SELECT *, CASE WHEN rate_high AND parallelism < 12 THEN 'rate_high'
                 WHEN rate_low AND parallelism > 3 THEN 'rate_low'
                 WHEN cpu_high THEN 'cpu_high' WHEN cpu_low THEN 'cpu_low' ELSE 'none' END AS rule
  FROM sustained),
recommended AS (
  SELECT *,
    CASE WHEN rule = 'rate_high' THEN 'parallelism_up'
         WHEN rule = 'rate_low' THEN 'parallelism_down'
         WHEN rule = 'cpu_high' AND worker_count < 6 THEN 'worker_up'
         WHEN rule = 'cpu_low' AND worker_count > 3 THEN 'worker_down'
         ELSE 'none' END AS action,
    CASE WHEN rule = 'rate_high' THEN least(parallelism + 2, 12)
         WHEN rule = 'rate_low' THEN greatest(parallelism - 1, 3)
         ELSE parallelism END AS target_parallelism,
    CASE WHEN rule = 'cpu_high' AND worker_count < 6 THEN worker_count + 1
         WHEN rule = 'cpu_low' AND worker_count > 3 THEN worker_count - 1
         ELSE worker_count END AS target_workers
  FROM ruled)"""
ALERT_TEXT = """concat_ws(' ', strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S'),
  '- ALERT:', job_id, action, concat('parallelism=', target_parallelism),
  concat('workers=', target_workers))"""

AGG_COLUMNS = """sensor_id, window_start_ts, window_end_ts,
  round(avg_amplitude, 6) AS avg_amplitude, max_amplitude, min_amplitude,
  p_phase_count, s_phase_count, n_phase_count, total_count"""
DEVIATION = """round(CASE WHEN history_avg > 0
  THEN (avg_amplitude - history_avg) / history_avg ELSE 0.0 END, 6)"""
TWO_PLACES = "printf('%.2f', round(CAST({} AS DOUBLE), 2))"


def _line(noise: bool) -> str:
    avg, top = TWO_PLACES.format("avg_amplitude"), TWO_PLACES.format("max_amplitude")
    tail = ", ' | N=', n_phase_count" if noise else ""
    return f"""concat('sensorId=', sensor_id, ' | window=[', window_start_ts, ', ',
  window_end_ts, ') | avg=', {avg}, ' | max=', {top}, ' | P=', p_phase_count,
  ' | S=', s_phase_count{tail})"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([READINGS, VALID, *parts]) + "\n"


def oracles() -> dict[str, str]:
    base = _with()
    agg = _with(AGG)
    history = _with(AGG, HISTORY)
    temporal = _with(AGG, HISTORY, TEMPORAL)
    celled = _with(CELLED)
    grid = _with(CELLED, GRID)
    spatial = _with(CELLED, SPATIAL)
    last_kept = _with(LAST_KEPT)
    first_seen = _with(FIRST_SEEN)
    metrics = f"WITH {METRICS}\n"
    sustained = f"WITH {METRICS}, {SUSTAINED}\n"
    recommended = f"WITH {METRICS}, {SUSTAINED}, {RECOMMENDED}\n"

    temporal_columns = """event_id, sensor_id, collect_timestamp, seismic_amplitude,
      round(history_avg, 6) AS history_avg, round(temporal_ratio, 6) AS temporal_ratio"""
    reasons = ", ".join(
        f"CASE WHEN NOT ({rule}) THEN '{name}' END" for name, rule in RULES.items()
    )
    counts = ", ".join(
        f"count(*) FILTER (WHERE NOT ({rule})) AS bad_{name}" for name, rule in RULES.items()
    )
    record_line = f"""concat('sensorId=', sensor_id, ' | amplitude=',
      {TWO_PLACES.format('seismic_amplitude')}, ' | quality=', data_quality)"""
    kth = """kth AS (
      SELECT sensor_id, coalesce(max(collect_timestamp) FILTER (WHERE rn = 2), 0) AS kth_access
      FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id
                                         ORDER BY collect_timestamp DESC) AS rn FROM valid)
      GROUP BY sensor_id)"""
    change = """sensor_id, event_id, collect_timestamp, seismic_amplitude,
      lag(event_id) OVER w IS NOT NULL AS has_previous,
      seismic_amplitude - lag(seismic_amplitude) OVER w AS amplitude_change,
      collect_timestamp - lag(collect_timestamp) OVER w AS time_diff,
      lag(seismic_amplitude) OVER w AS previous_amplitude"""
    change_sql = (
        last_kept + f"SELECT {change} FROM kept "
        "WINDOW w AS (PARTITION BY sensor_id ORDER BY collect_timestamp, event_id)"
    )
    history_sql = (
        history + f"SELECT sensor_id, window_start_ts, round(avg_amplitude, 6) AS avg_amplitude,"
        f" round(history_avg, 6) AS history_avg, {DEVIATION} AS deviation FROM history"
    )
    step_sql = history + """SELECT sensor_id, window_start_ts,
        round(CASE WHEN previous_avg = 0 THEN 0.0
                   ELSE abs(avg_amplitude - previous_avg) / abs(previous_avg) END, 6)
          AS step_deviation FROM history"""
    kept_sql = last_kept + "SELECT * FROM kept"
    scores_sql = spatial + f"SELECT {SCORE_COLUMNS} FROM scores"
    window_sql = agg + f"SELECT {AGG_COLUMNS} FROM agg"
    rate_sql = """WITH c AS (
        SELECT event_id AS sample_id, concat('job_', user_id % 16) AS job_id,
          epoch_us(ts) // 1000000 AS t,
          CASE WHEN event_id % 50 = 7 THEN 0 ELSE event_id * 100000 END AS total_records
        FROM events),
      d AS (SELECT *, total_records - lag(total_records) OVER w AS dn, t - lag(t) OVER w AS dt
        FROM c WINDOW w AS (PARTITION BY job_id ORDER BY t, sample_id))
      SELECT sample_id, job_id, t AS ts, total_records,
        CASE WHEN dt > 0 AND dn >= 0 THEN dn // dt ELSE 0 END AS rate FROM d"""

    found = {
        # sources
        "payload_roundtrip": base + "SELECT * FROM readings WHERE event_id % 50 <> 0",
        "payload_quarantine": "SELECT event_id, 'FFFF' AS payload_hex FROM events "
        "WHERE event_id % 50 = 0",
        "bounded_read": base
        + "SELECT * FROM readings ORDER BY collect_timestamp, event_id LIMIT 1000",
        "metrics_log": metrics
        + "SELECT ts, throughput, round(cpu, 4) AS cpu FROM metrics",
        "metrics_log_odd": metrics
        + """SELECT CASE sample_id % 3
              WHEN 0 THEN printf('? %d,throughput:%d,cpu:%.4f', ts, throughput, cpu)
              WHEN 1 THEN printf('%d,throughput:1', ts) ELSE CAST(ts AS VARCHAR) END AS line
            FROM metrics WHERE sample_id % 50 = 0""",
        # quality
        "valid_readings": base + "SELECT * FROM valid",
        "reject_report": base
        + f"""SELECT event_id, sensor_id, data_quality, seismic_amplitude,
            concat_ws(',', {reasons}) AS failed_rules FROM readings WHERE NOT ({IS_VALID})""",
        "reject_counts": base
        + f"""SELECT count(*) AS total, count(*) FILTER (WHERE NOT ({IS_VALID})) AS rejected,
            {counts} FROM readings""",
        "critical_readings": base
        + """SELECT event_id, sensor_id, seismic_amplitude,
            seismic_amplitude > 50 AS is_critical FROM valid""",
        "decoded_line": base
        + f"SELECT event_id, {record_line} AS line FROM readings WHERE event_id % 50 <> 0",
        # windows
        "window_agg": window_sql,
        "window_agg_negative": agg + f"SELECT {AGG_COLUMNS} FROM agg WHERE max_amplitude < 0",
        "agg_line": agg + f"SELECT sensor_id, window_start_ts, {_line(True)} AS line FROM agg",
        "agg_csv": agg
        + """SELECT sensor_id, window_start_ts, concat_ws(',', sensor_id, window_start_ts,
            window_end_ts, CAST(round(avg_amplitude, 3) AS VARCHAR), max_amplitude,
            min_amplitude, p_phase_count, s_phase_count, n_phase_count) AS csv FROM agg""",
        # history
        "history_baseline": history_sql,
        "history_baseline_split": history_sql,
        "history_max": history + "SELECT sensor_id, window_start_ts, history_max FROM history",
        "last_windows": agg
        + """SELECT * FROM (SELECT sensor_id, window_start_ts,
              round(avg_amplitude, 6) AS avg_amplitude,
              row_number() OVER (PARTITION BY sensor_id ORDER BY window_start_ts DESC) AS age_rank
            FROM agg) WHERE age_rank <= 3""",
        "window_step_deviation": step_sql,
        "window_step_deviation_split": step_sql,
        "temporal_scores": temporal + f"SELECT {temporal_columns} FROM temporal",
        "temporal_anomalies": temporal
        + f"""SELECT {temporal_columns} FROM temporal
            WHERE temporal_ratio > 1.5 OR temporal_ratio < 0.5""",
        "history_coverage": history
        + """SELECT count(*) AS windows, count(history_avg) AS hits,
            count(*) - count(history_avg) AS misses,
            round(count(history_avg) / count(*), 6) AS hit_rate FROM history""",
        # spatial
        "grid_keys": celled
        + "SELECT event_id, gx, gy, concat('GRID_', gx, '_', gy) AS grid_key FROM celled",
        "grid_agg": grid + f"SELECT {GRID_COLUMNS} FROM grid",
        "grid_agg_by_sensor": _with(CELLED, _grid("grid", "sensor_id,"))
        + f"SELECT sensor_id, {GRID_COLUMNS} FROM grid",
        "grid_merge": grid + f"SELECT {GRID_COLUMNS} FROM grid",
        "neighbour_keys": grid
        + """SELECT gx, gy, gx + dx AS nx, gy + dy AS ny,
              concat('GRID_', gx + dx, '_', gy + dy) AS neighbour_key
            FROM grid, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)
            WHERE dx <> 0 OR dy <> 0""",
        "neighbourhood_agg": grid
        + """SELECT a.gx, a.gy, a.grid_key, CAST(sum(b.record_count) AS BIGINT) AS record_count,
              round(sum(b.sum_amplitude), 6) AS sum_amplitude,
              max(b.max_amplitude) AS max_amplitude, min(b.min_amplitude) AS min_amplitude,
              round(sum(b.sum_amplitude) / sum(b.record_count), 6) AS avg_amplitude,
              CAST(sum(b.p_wave_count) AS BIGINT) AS p_wave_count,
              CAST(sum(b.s_wave_count) AS BIGINT) AS s_wave_count,
              max(b.last_update) AS last_update
            FROM grid a JOIN grid b ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1
            GROUP BY a.gx, a.gy, a.grid_key""",
        "latest_grids": grid
        + f"SELECT {GRID_COLUMNS} FROM grid ORDER BY last_update DESC, grid_key LIMIT 10",
        "spatial_scores": scores_sql,
        "spatial_scores_split": scores_sql,
        "spatial_anomalies": spatial + f"SELECT {SCORE_COLUMNS} FROM scores WHERE spatial_ratio > 1.5",
        "regional_anomalies": spatial
        + f"""SELECT {SCORE_COLUMNS} FROM scores
            WHERE neighbourhood_avg - CAST(seismic_amplitude AS DOUBLE) <> 0
              AND CAST(seismic_amplitude AS DOUBLE)
                  / (neighbourhood_avg - CAST(seismic_amplitude AS DOUBLE)) > 1.5""",
        # dedup
        "dedup_last_kept": kept_sql,
        "dedup_last_kept_split": kept_sql,
        "dedup_off": base + "SELECT * FROM valid",
        "dedup_first_seen": first_seen + "SELECT * FROM kept",
        "dedup_stats": last_kept
        + """SELECT sensor_id, count(*) AS input_count,
              count(*) FILTER (WHERE NOT is_duplicate) AS output_count,
              count(*) FILTER (WHERE is_duplicate) AS skipped_count,
              round(count(*) FILTER (WHERE is_duplicate) * CAST(100 AS DOUBLE) / count(*), 6) AS skip_percent
            FROM flagged GROUP BY ROLLUP (sensor_id)""",
        "change_info": change_sql,
        "change_info_split": change_sql,
        "active_sensors": base
        + """SELECT sensor_id, max(collect_timestamp) AS last_seen FROM valid
            WHERE collect_timestamp <= 1705708800000 GROUP BY sensor_id
            HAVING 1705708800000 - max(collect_timestamp) <= 21600000""",
        # ranking
        "kth_access": _with(kth) + "SELECT * FROM kth",
        "access_frequency": base
        + """SELECT sensor_id, count(*) AS access_count,
              min(collect_timestamp) AS first_access,
              round(count(*) * CAST(1000 AS DOUBLE) / (1706659200000 - min(collect_timestamp)), 9) AS frequency
            FROM valid GROUP BY sensor_id""",
        "decayed_frequency": base
        + """SELECT sensor_id, count(*) AS access_count, max(collect_timestamp) AS last_access,
              round(count(*) * pow(CAST(0.99999 AS DOUBLE),
                    (1706659200000 - max(collect_timestamp)) / CAST(1000 AS DOUBLE)), 6) AS decayed_frequency
            FROM valid GROUP BY sensor_id""",
        "coldest_sensors": _with(kth) + "SELECT * FROM kth ORDER BY kth_access, sensor_id LIMIT 20",
        "hottest_sensors": _with(kth)
        + "SELECT * FROM kth ORDER BY kth_access DESC, sensor_id LIMIT 20",
        # metrics
        "counter_rate": rate_sql,
        "counter_rate_split": rate_sql,
        "mean_load": """SELECT epoch_us(ts) // 3600000000 * 3600 AS ts,
              count(*) AS nodes,
              (CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT))
                FILTER (event_id % 41 <> 0 AND event_id % 720 >= 60), 0) AS BIGINT)
                // (10 * count(*))) / 10000.0 AS cpu
            FROM events GROUP BY 1""",
        "metrics_retention": metrics + "SELECT * FROM metrics WHERE ts >= 1706659200 - 604800",
        "sustained_threshold": sustained
        + "SELECT sample_id, job_id, ts, rate_high, rate_low, cpu_high, cpu_low FROM sustained",
        "scaling_recommendation": recommended
        + """SELECT sample_id, job_id, ts, rule, action, target_parallelism, target_workers
            FROM recommended""",
        "scaling_alerts": f"WITH {METRICS}, recent AS (SELECT * FROM metrics "
        f"WHERE ts >= 1706659200 - 604800), {_sustained('recent')}, {RECOMMENDED}\n"
        + f"SELECT sample_id, job_id, ts, {ALERT_TEXT} AS alert FROM recommended "
        "WHERE action <> 'none'",
        "log_alerts": f"WITH {METRICS}, logged AS (SELECT * REPLACE (round(cpu, 4) AS cpu, "
        "6 AS parallelism, 4 AS worker_count) FROM metrics WHERE ts >= 1706659200 - 604800), "
        f"{_sustained('logged')}, {RECOMMENDED}\n"
        + f"SELECT job_id, ts, {ALERT_TEXT} AS alert FROM recommended WHERE action <> 'none'",
        "stage_counts": last_kept
        + """SELECT 'read' AS stage, count(*) AS records FROM readings
            UNION ALL SELECT 'valid', count(*) FROM valid
            UNION ALL SELECT 'kept', count(*) FROM kept""",
        # composed jobs
        "filter_aggregate": agg
        + f"SELECT sensor_id, window_start_ts, {_line(True)} AS line FROM agg",
        "first_seen_aggregate": _with(FIRST_SEEN, _aggregate("agg", "kept"))
        + f"SELECT sensor_id, window_start_ts, {_line(True)} AS line FROM agg",
        "last_kept_aggregate": _with(LAST_KEPT, _aggregate("agg", "kept"), _history("agg"))
        + f"""SELECT sensor_id, window_start_ts, {_line(False)} AS line,
            round(history_avg, 6) AS history_avg, {DEVIATION} AS deviation FROM history""",
        "last_kept_spatial": _with(
            LAST_KEPT, CELLED.replace("FROM valid", "FROM kept"), _spatial("celled")
        )
        + f"SELECT {SCORE_COLUMNS}, spatial_ratio > 1.5 AS is_spatial_anomaly FROM scores",
        "last_kept_job": _with(
            LAST_KEPT,
            CELLED.replace("FROM valid", "FROM kept"),
            _spatial("celled"),
            _aggregate("agg", "kept"),
            _history("agg"),
        )
        + f"""SELECT {SCORE_COLUMNS}, spatial_ratio > 1.5 AS is_spatial_anomaly, window_start_ts,
            round(avg_amplitude, 6) AS avg_amplitude, round(history_avg, 6) AS history_avg,
            {DEVIATION} AS deviation
          FROM scores JOIN history USING (sensor_id)
          WHERE window_start_ts = collect_timestamp - collect_timestamp % {DAY}""",
        # streams
        "stream_window_agg": window_sql,
        "stream_dedup_last_kept": kept_sql,
        "stream_dedup_first_seen": first_seen + "SELECT * FROM kept",
        "stream_spatial_scores": scores_sql,
        "dedup_last_kept_defaults": _with(DENSE, KEPT_BY_DEFAULT)
        + "SELECT event_id, sensor_id, collect_timestamp FROM kept",
        "stream_restarted": kept_sql,
        "stream_csv_files": window_sql,
        "stream_processing_time": base
        + """SELECT sensor_id, count(*) AS total_count,
            count(*) FILTER (WHERE phase_type = 'P') AS p_phase_count,
            count(*) FILTER (WHERE phase_type = 'S') AS s_phase_count,
            count(*) FILTER (WHERE phase_type NOT IN ('P', 'S')) AS n_phase_count,
            max(seismic_amplitude) AS max_amplitude, min(seismic_amplitude) AS min_amplitude
          FROM valid GROUP BY sensor_id""",
        "stream_last_kept_aggregate": _with(LAST_KEPT, _aggregate("agg", "kept"))
        + f"SELECT {AGG_COLUMNS} FROM agg",
    }
    # The stream form of a job gives the rows of the batch form.
    found["stream_filter_aggregate"] = found["filter_aggregate"]
    found["stream_first_seen_aggregate"] = found["first_seen_aggregate"]
    found["stream_last_kept_job"] = found["last_kept_aggregate"]
    found["stream_log_alerts"] = found["log_alerts"]
    found["stream_payload_roundtrip"] = found["payload_roundtrip"]
    found["stream_payload_quarantine"] = found["payload_quarantine"]
    found["stream_compacted_windows"] = window_sql
    found["stream_rolled_csv"] = agg + f"SELECT {AGG_COLUMNS.replace(', total_count', '')} FROM agg"
    found["stream_dedup_stats"] = found["dedup_stats"]
    found["stream_queues"] = base + "SELECT * FROM readings"
    found["neighbourhood_agg_wide"] = found["neighbourhood_agg"].replace("<= 1", "<= 10")
    found["stream_activity"] = base + " UNION ALL ".join(
        f"""SELECT sensor_id, {at} AS as_of FROM valid WHERE collect_timestamp <= {at}
            GROUP BY sensor_id HAVING {at} - max(collect_timestamp) <= 21600000"""
        for at in (1704844800000, 1705708800000, 1706400000000)
    )
    found["stream_progress"] = (
        base
        + """SELECT stage, count(*) AS records FROM readings, (SELECT unnest(['input', 'read']) AS stage)
            GROUP BY stage UNION ALL SELECT 'valid', count(*) FROM valid"""
    )
    return found
