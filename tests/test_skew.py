"""Cutting hot keys must not change any result.

A third of all readings is moved to one sensor (and one grid cell), packed densely in
time, and every split form is compared with the whole form and with plain Python.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremora.operators import dedup, scaling, spatial
from tremora.operators.chunks import PIECE, WHOLE, calendar_pieces, plan_pieces
from tremora.operators.history import with_history, with_step_deviation
from tremora.operators.windows import window_agg
from tremora.sources import events

HOT = "sensor_hot"


@pytest.fixture(scope="module")
def skewed(spark, data_dir):
    """Readings a thousand times denser in time, a third of them on one sensor and cell."""
    hot = F.col("event_id") % 3 == 0
    df = (
        events.readings(spark, data_dir)
        .withColumn("collect_timestamp", F.expr("collect_timestamp div 1000"))
        .withColumn("sensor_id", F.when(hot, F.lit(HOT)).otherwise(F.col("sensor_id")))
        .withColumn("longitude", F.when(hot, F.lit(108.005)).otherwise(F.col("longitude")))
        .withColumn("latitude", F.when(hot, F.lit(34.005)).otherwise(F.col("latitude")))
        .cache()
    )
    df.count()
    yield df
    df.unpersist()


def plain_fold(rows, amp_thr, gap, ttl):
    """The rule as written, one sensor after the other."""
    kept = []
    rows = sorted(rows, key=lambda r: (r.sensor_id, r.collect_timestamp, r.event_id))
    for _, group in groupby(rows, key=lambda r: r.sensor_id):
        base = created = None
        for r in group:
            a, t = np.float32(r.seismic_amplitude), r.collect_timestamp
            if created is not None and t - created > ttl:
                base = created = None
            if base and float(abs(a - base[0])) < amp_thr and t - base[1] < gap:
                continue
            created = t if created is None else created
            base = (a, t)
            kept.append(r.event_id)
    return sorted(kept)


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def test_plan_cuts_only_the_hot_key(skewed):
    plan = dedup.plan_sensors(skewed, target_rows=400)
    sizes = {
        (r.sensor_id, r[PIECE]): r["count"]
        for r in plan.assign(skewed).groupBy("sensor_id", PIECE).count().collect()
    }
    hot = {k: n for k, n in sizes.items() if k[0] == HOT}
    assert len(hot) >= 8 and max(hot.values()) < 800
    assert {k[1] for k in sizes if k[0] != HOT} == {WHOLE}
    assert sum(sizes.values()) == skewed.count()


def test_every_key_above_the_target_is_cut(spark):
    rows = spark.range(300_000).selectExpr(
        "concat('sensor_', id % 3000) AS sensor_id", "id AS collect_timestamp"
    )
    plan = plan_pieces(rows, ["sensor_id"], "collect_timestamp", target_rows=20)
    assert plan.cuts.count() == 3000
    sizes = plan.assign(rows).groupBy("sensor_id", PIECE).count()
    assert sizes.count() == 15_000 and sizes.agg(F.max("count")).first()[0] <= 40


@pytest.mark.parametrize("n", [20_000, 100_000])
def test_pieces_follow_the_rows_and_not_the_span(spark, n):
    """Outliers at both ends, nine tenths of the rows in a hundredth of the span, one busy moment."""
    rows = spark.range(n).selectExpr(
        "CASE WHEN id % 5 = 0 THEN 'cold' ELSE 'hot' END AS sensor_id",
        """CASE WHEN id = 1 THEN -9000000000000 WHEN id = 2 THEN 9000000000000 WHEN id = 3 THEN NULL
           WHEN id % 10 = 1 THEN id * 1000 WHEN id % 100 = 7 THEN 500000 ELSE 40000000 + id * 10 END AS ts""",
    )
    target = n // 50
    plan = plan_pieces(rows, ["sensor_id"], "ts", target_rows=target)
    assigned = plan.assign(rows).cache()
    sizes = assigned.where("sensor_id = 'hot'").groupBy(PIECE).count().collect()
    assert max(r["count"] for r in sizes) <= 2 * target and len(sizes) >= 30
    assert assigned.count() == rows.count()
    # Pieces are in time order, and no moment is in two of them.
    spans = assigned.where("sensor_id = 'hot'").groupBy(PIECE).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    spans = [(r.lo, r.hi) for r in spans.orderBy(PIECE).collect() if r.lo is not None]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert assigned.where("ts IS NULL").first()[PIECE] == 0
    assigned.unpersist()


def test_cuts_kept_as_a_table(spark, monkeypatch):
    from tremora.operators import chunks

    rows = spark.range(30_000).selectExpr("concat('s', id % 300) AS sensor_id", "id * id % 99991 AS ts")
    local = plan_pieces(rows, ["sensor_id"], "ts", target_rows=20)
    monkeypatch.setattr(chunks, "MOST_LOCAL_CUTS", 64)
    stored = plan_pieces(rows, ["sensor_id"], "ts", target_rows=20)
    a, b = (sorted(map(tuple, p.assign(rows).collect())) for p in (local, stored))
    assert a == b and len({x[2] for x in a}) == 5


def test_one_key_in_very_many_pieces(spark):
    rows = spark.range(100_000).selectExpr("'a' AS sensor_id", "id * 7 AS collect_timestamp")
    plan = plan_pieces(rows, ["sensor_id"], "collect_timestamp", target_rows=10)
    sizes = plan.assign(rows).groupBy(PIECE).count()
    assert sizes.count() >= 9_000 and sizes.agg(F.max("count")).first()[0] <= 20


def test_blocks_are_cut_by_what_they_receive(spark):
    """One busy cell in the corner of a block: its copies must not pile up next door."""
    busy = spark.range(20_000).selectExpr("id AS event_id", "id AS collect_timestamp", "8 AS cell")
    calm = spark.range(20).selectExpr("id + 20000", "id * 1000", "7")
    rows = busy.union(calm).selectExpr(
        "event_id", "'sensor_1' AS sensor_id", "collect_timestamp", "cell * 0.01D + 0.005D AS longitude",
        "cell * 0.01D + 0.005D AS latitude", "CAST(1 AS FLOAT) AS seismic_amplitude",
    )
    plan = spatial.plan_blocks(rows, 0.01, target_rows=1_000)
    sent = spatial.sent_to_blocks(rows, 0.01, 1)
    sizes = plan.assign(sent).groupBy("bx", "by", PIECE).count()
    assert sizes.select("bx", "by").distinct().count() == 4
    assert sizes.agg(F.max("count")).first()[0] <= 2_000


def test_no_hot_key_no_cuts(skewed):
    assert dedup.plan_sensors(skewed).is_whole


@pytest.mark.parametrize(
    "amp,gap,ttl",
    [
        (30.0, 1_500, 20_000),  # both kinds of restart occur
        (1000.0, 3_000, 60_000),  # amplitude never matters: long runs of duplicates
        (30.0, 10**9, 15_000),  # restarts only where the baseline ends
        (30.0, 2_000, 10**12),  # restarts only at gaps
        (30.0, 10**9, 10**12),  # no restart at all: one chain through all pieces
        (20.0, 1, 1),
    ],
)
def test_last_kept_split_equals_whole(skewed, amp, gap, ttl):
    expected = plain_fold(skewed.collect(), amp, gap, ttl)
    assert ids(dedup.dedup_last_kept(skewed, amp, gap, ttl)) == expected
    plan = dedup.plan_sensors(skewed, target_rows=150)
    assert not plan.is_whole
    assert ids(dedup.dedup_last_kept(skewed, amp, gap, ttl, plan=plan)) == expected


def test_last_kept_state_crosses_arrow_batches(spark, skewed):
    expected = plain_fold(skewed.collect(), 30.0, 1_500, 20_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert ids(dedup.dedup_last_kept(skewed, 30.0, 1_500, 20_000)) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_change_info_split_equals_whole(skewed):
    plan = dedup.plan_sensors(skewed, target_rows=150)
    whole = dedup.with_change_info(skewed)
    split = dedup.with_change_info(skewed, plan).select(whole.columns)
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))


@pytest.mark.parametrize("radius", [1, 2])
def test_spatial_split_equals_whole(skewed, radius):
    columns = ["event_id", "neighbourhood_avg", "spatial_ratio"]
    whole = spatial.score_spatial(skewed, 0.01, radius).select(columns)
    plan = spatial.plan_blocks(skewed, 0.01, target_rows=100)
    split = spatial.score_spatial(skewed, 0.01, radius, plan).select(columns)
    a = {r[0]: r[1:] for r in whole.collect()}
    b = {r[0]: r[1:] for r in split.collect()}
    assert len(a) == skewed.count() and a.keys() == b.keys()
    for key in a:
        assert b[key] == pytest.approx(a[key], rel=1e-9, abs=1e-9)


def test_history_pieces_equal_whole(skewed):
    agg = window_agg(skewed, 1_000).cache()
    for width in (1_000, 7_000, 10**9):
        plan = calendar_pieces(["sensor_id"], "window_start_ts", width)
        for function in (lambda df, p: with_history(df, 10, p), with_step_deviation):
            whole = function(agg, None)
            split = function(agg, plan).select(whole.columns)
            assert split.exceptAll(whole).count() == 0 == whole.exceptAll(split).count()
    agg.unpersist()


def test_sustained_keeps_samples_without_a_time(spark):
    rows = [("a", t, 5000) for t in (10, 20, 30)] + [("a", None, 5000)] * 2 + [("b", None, 1)]
    df = spark.createDataFrame(rows, "job_id string, ts long, throughput long")
    found = scaling.sustained(df, {"high": F.col("throughput") > 3000}, 50).collect()
    assert sorted((r.job_id, r.ts or 0, r.high) for r in found) == [
        ("a", 0, False), ("a", 0, False), ("a", 10, False), ("a", 20, False), ("a", 30, True), ("b", 0, False),
    ]


def test_sustained_slices_equal_one_slice(spark, data_dir):
    metrics = events.metrics(spark, data_dir)
    rules = {"high": F.col("throughput") > 3000, "low": F.col("cpu") < 0.5}
    small = scaling.sustained(metrics, rules, 21_600, slice_seconds=1)
    large = scaling.sustained(metrics, rules, 21_600, slice_seconds=10**9)
    assert small.where("high").count() > 0
    assert small.exceptAll(large).count() == 0 == large.exceptAll(small).count()


def test_spatial_sums_cross_arrow_batches(spark, skewed):
    whole = spatial.score_spatial(skewed).select("event_id", "neighbourhood_avg").collect()
    plan = spatial.plan_blocks(skewed, target_rows=300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        for chosen in (None, plan):
            batched = spatial.score_spatial(skewed, plan=chosen)
            got = dict(batched.select("event_id", "neighbourhood_avg").collect())
            assert all(got[r[0]] == pytest.approx(r[1], abs=1e-9) for r in whole)
            assert len(got) == len(whole)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
