"""Log segments as a stream: positions, parts, restarts."""

from __future__ import annotations

import io
import random

import pytest

from tremora.sources import segments
from tremora.streaming import runner


@pytest.mark.parametrize("split", [1, 7, 64, 10_000])
def test_every_record_is_in_one_part(split):
    random_ = random.Random(split)
    lines = [("é" if random_.random() < 0.2 else "x") * random_.choice([0, 0, 1, 5, 30]) for _ in range(200)]
    data = "".join(line + "\n" for line in lines).encode()
    found = []
    for lo in range(0, len(data), split):
        part = segments.Part("q", 1000, "", lo, min(lo + split, len(data)), lo > 0)
        for batch in segments.records(io.BytesIO(data), part):
            found += zip(batch.column("position").to_pylist(), batch.column("value").to_pylist())
    assert [v for _, v in found] == lines
    at = 1000
    for position, value in found:
        assert position == at
        at += len(value.encode()) + 1


def test_blocks_smaller_than_records(monkeypatch):
    monkeypatch.setattr(segments, "BATCH_BYTES", 3)
    data = b"one\ntwo and more\n\nfour\n"
    for split in (2, 5, 100):
        found = []
        for lo in range(0, len(data), split):
            part = segments.Part("q", 0, "", lo, min(lo + split, len(data)), lo > 0)
            for batch in segments.records(io.BytesIO(data), part):
                found += batch.column("value").to_pylist()
        assert found == ["one", "two and more", "", "four"]


def run(spark, path, split):
    stream = segments.read_segments_stream(spark, f"{path}/logs", split)
    runner.append_to_table(stream, f"{path}/out", f"{path}/state").awaitTermination()
    rows = spark.read.schema(segments.RECORD).parquet(f"{path}/out").collect()
    return sorted((r.queue, r.position, r.value) for r in rows)


@pytest.mark.parametrize("split", [9, 1 << 20])
def test_restart_within_a_segment(spark, tmp_path, split):
    logs, expected = tmp_path / "logs", []

    def write(queue, base, text, mode="ab"):
        (logs / f"queue={queue}").mkdir(parents=True, exist_ok=True)
        with open(logs / f"queue={queue}" / f"{base:020}.log", mode) as file:
            file.write(text.encode())

    write("a", 0, "a0\na1\na2 has no en")
    write("b", 0, "")
    assert run(spark, tmp_path, split) == [("a", 0, "a0"), ("a", 3, "a1")]
    write("a", 0, "d yet\na3\n")  # the same segment goes on
    write("a", 26, "a4\n")  # and a new one begins
    write("c", 0, "c0\n")  # a queue that was not there
    expected = [("a", 0, "a0"), ("a", 3, "a1"), ("a", 6, "a2 has no end yet"), ("a", 24, "a3")]
    size = (logs / "queue=a" / f"{0:020}.log").stat().st_size
    assert size == 27
    (logs / "queue=a" / f"{26:020}.log").rename(logs / "queue=a" / f"{27:020}.log")
    assert run(spark, tmp_path, split) == [*expected, ("a", 27, "a4"), ("c", 0, "c0")]
    write("b", 0, "b0\n")
    assert run(spark, tmp_path, split)[-2:] == [("b", 0, "b0"), ("c", 0, "c0")]
    assert len(run(spark, tmp_path, split)) == 7


def test_lost_segments_are_an_error(tmp_path):
    (tmp_path / "queue=a").mkdir()
    (tmp_path / "queue=a" / f"{50:020}.log").write_text("x\n")
    reader = segments.SegmentReader(str(tmp_path), 100)
    assert reader.latestOffset() == {"a": 52} and reader.partitions({"a": 50}, {"a": 52})
    with pytest.raises(ValueError, match="no longer there"):
        reader.partitions({}, {"a": 52})


def test_parts_of_a_large_batch(spark, tmp_path, monkeypatch):
    """The number of tasks and files follows the cores and not the bytes."""
    lines = [f"{q}{i}" + "é" * (i % 9) for q in "ab" for i in range(600)]
    for q in "ab":
        (tmp_path / "logs" / f"queue={q}").mkdir(parents=True)
        text = "".join(line + "\n" for line in lines if line[0] == q)
        (tmp_path / "logs" / f"queue={q}" / f"{0:020}.log").write_text(text)
    reader = segments.SegmentReader(f"{tmp_path}/logs", 100, 6)
    end = reader.latestOffset()
    made = reader.partitions({}, end)
    assert 6 <= len(made) <= 8
    assert [(p.lo, p.hi) for p in reader.partitions({"a": end["a"], "b": end["b"] - 250}, end)] == [
        (end["b"] - 250 + at, min(end["b"], end["b"] - 150 + at)) for at in (0, 100, 200)
    ]
    assert sorted(v for _, _, v in run(spark, tmp_path, 100)) == sorted(lines)
    files = [p for p in (tmp_path / "out").iterdir() if p.suffix == ".parquet"]
    assert len(files) <= segments.PARTS_PER_CORE * spark.sparkContext.defaultParallelism + 2
    monkeypatch.setattr(segments, "SPLIT_BYTES", 300)  # of a huge batch, no part is larger than this
    assert max(p.hi - p.lo for p in reader.partitions({}, end)) == 300
