"""Files that roll by size, age and idle time."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tremora.sinks import rolling
from tremora.streaming import runner


def start(spark, path, **limits):
    lines = spark.readStream.schema("value string").text(f"{path}/in")
    with runner.stream_settings(spark, 2):
        return rolling.write_rolled(rolling.rolled(lines, "value", **limits), f"{path}/out", f"{path}/state", "500 milliseconds")


def add(spark, path, values):
    rows = spark.createDataFrame([(v,) for v in values], "value string")
    rows.coalesce(1).write.mode("append").text(f"{path}/in")


def files(path):
    found = {f.name: f.read_text() for f in sorted((path / "out").glob("part-*"))} if (path / "out").exists() else {}
    assert not list((path / "out").glob(".part-*.csv")) if found else True
    return found


def read_all(query, n):
    """Timers keep micro-batches coming, so wait for the rows and not for idleness."""
    assert until(lambda: sum(p.numInputRows for p in query.recentProgress) >= n)


def until(condition, seconds=90):
    for _ in range(seconds * 4):
        if condition():
            return True
        time.sleep(0.25)
    return False


def test_files_keep_their_limits_over_a_restart(spark, tmp_path):
    far = {"max_age_ms": 10**9, "idle_ms": 10**9}
    first = [f"line {i} " + "x" * (i % 50) for i in range(400)]
    add(spark, tmp_path, first)
    query = start(spark, tmp_path, slots=2, max_bytes=1_000, **far)
    read_all(query, 400)
    query.stop()
    before = files(tmp_path)
    assert len(before) > 8 and all(len(text) <= 1_000 for text in before.values())
    assert all(len(text) > 900 for text in before.values())  # full ones only; the rest waits in state
    more = ["é" * 700, *[f"more {i}" for i in range(100)]]  # one line beyond the limit
    add(spark, tmp_path, more)
    query = start(spark, tmp_path, slots=2, max_bytes=1_000, **far)
    read_all(query, 101)
    query.stop()
    after = files(tmp_path)
    assert all(after[name] == text for name, text in before.items())
    written = "".join(after.values()).splitlines()
    assert len(written) == len(set(written)) and set(written) <= {*first, *more}
    for slot in (0, 1):  # numbered without gaps
        numbers = sorted(int(n[-12:-4]) for n in after if n.startswith(f"part-{slot:05}"))
        assert numbers == list(range(len(numbers)))


@pytest.mark.parametrize("limits", [{"idle_ms": 700, "max_age_ms": 10**9}, {"idle_ms": 10**9, "max_age_ms": 700}])
def test_what_waits_rolls_by_time(spark, tmp_path, limits):
    add(spark, tmp_path, ["a", "b", ""])
    query = start(spark, tmp_path, slots=1, max_bytes=10**6, **limits)
    try:
        assert until(lambda: files(tmp_path))
        add(spark, tmp_path, ["c"])
        assert until(lambda: len(files(tmp_path)) == 2)
    finally:
        query.stop()
    assert [sorted(text.splitlines()) for text in files(tmp_path).values()] == [["", "a", "b"], ["c"]]


def test_repeated_batch_writes_the_same_files(spark, tmp_path):
    add(spark, tmp_path, [f"line {i}" for i in range(300)])
    far = {"max_age_ms": 10**9, "idle_ms": 10**9}
    query = start(spark, tmp_path, slots=2, max_bytes=500, **far)
    read_all(query, 300)
    query.stop()
    before = files(tmp_path)
    for done in (tmp_path / "state" / "commits").iterdir():  # as if it had died before its first commit
        if done.name.strip(".").split(".")[0].isdigit():
            done.unlink()
    for later in (tmp_path / "state" / "offsets").iterdir():
        if later.name.strip(".").split(".")[0].isdigit() and not later.name.strip(".").startswith("0"):
            later.unlink()
    query = start(spark, tmp_path, slots=2, max_bytes=500, **far)
    read_all(query, 300)
    query.stop()
    assert files(tmp_path) == before and len(before) > 3


def test_nothing_is_lost(spark, tmp_path):
    values = [f"row {i}" for i in range(1_000)]
    add(spark, tmp_path, values)
    query = start(spark, tmp_path, slots=3, max_bytes=700, idle_ms=500, max_age_ms=10**9)
    try:
        assert until(lambda: sum(t.count("\n") for t in files(tmp_path).values()) >= 1_000)
    finally:
        query.stop()
    back = spark.read.text(f"{tmp_path}/out").agg(F.count("*"), F.count_distinct("value")).first()
    assert tuple(back) == (1_000, 1_000)
