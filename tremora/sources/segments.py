"""A queue-like source: append-only log segments with a position per queue.

A queue is a folder ``queue=<name>``; its log is cut into segment files named by the position of
their first byte (20 digits, then ``.log``). A record is a line of UTF-8 text, its position is that
of its first byte in the whole log. Writers add to the last segment or begin a new one; a line that
has no end yet is no record.

The stream's offset is a map from queue to the position up to which it has been read, kept in the
query's checkpoint: a restart goes on at that byte, in the middle of a segment too. A micro-batch is
cut into parts, of all queues and segments, which are read in parallel; a part that begins inside a
record leaves it to the part before. A part is a task and a file of the sink, so a large batch is cut
into larger parts: PARTS_PER_CORE for each core if that makes them larger than ``split_bytes``, yet
of SPLIT_BYTES at most. Queues that appear later are read from their beginning.

Files are read by Arrow, so the path is a local or mounted one or a store that Arrow knows. Register
the source once per session: ``register(spark)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "log_segments"
RECORD = T.StructType(
    [
        T.StructField("queue", T.StringType()),
        T.StructField("position", T.LongType()),
        T.StructField("value", T.StringType()),
    ]
)
SPLIT_BYTES = 64 << 20
PARTS_PER_CORE = 3
BATCH_BYTES = 1 << 20
FOLDER, SUFFIX = "queue=", ".log"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def segments(path: str) -> dict[str, list[tuple[int, int, str]]]:
    """Of each queue: first position, size and file of its segments, in order."""
    files, root = _open(path)
    found: dict[str, list[tuple[int, int, str]]] = {}
    for info in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        folder, _, name = info.path.rpartition("/")
        queue = folder.rpartition("/")[2]
        if info.type == fs.FileType.File and name.endswith(SUFFIX) and queue.startswith(FOLDER):
            found.setdefault(queue.removeprefix(FOLDER), []).append((int(name.removesuffix(SUFFIX)), info.size, info.path))
    return {queue: sorted(parts) for queue, parts in found.items()}


def end_of_records(files: fs.FileSystem, path: str, size: int) -> int:
    """Bytes of a file up to the end of its last whole line, looked for from the end."""
    with files.open_input_file(path) as file:
        hi = size
        while hi:
            lo = max(0, hi - BATCH_BYTES)
            file.seek(lo)
            at = file.read(hi - lo).rfind(b"\n")
            if at >= 0:
                return lo + at + 1
            hi = lo
    return 0


@dataclass
class Part(InputPartition):
    queue: str
    base: int  # position of the file's first byte
    file: str
    lo: int  # in the file
    hi: int
    inside: bool  # does it begin inside of what is read, so maybe inside of a record?


class SegmentReader(DataSourceStreamReader):
    def __init__(self, path: str, split_bytes: int, parts: int | None = None):
        self.path, self.split_bytes, self.parts = path, split_bytes, parts

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, _ = _open(self.path)
        ends = {}
        for queue, parts in segments(self.path).items():
            base, size, file = parts[-1]
            ends[queue] = base + end_of_records(files, file, size)
        return ends

    def part_bytes(self, total: int) -> int:
        """Size of the parts of a batch of ``total`` bytes."""
        if not self.parts:
            return self.split_bytes
        return max(self.split_bytes, min(-(-total // self.parts), SPLIT_BYTES))

    def partitions(self, start: dict, end: dict) -> list[Part]:
        made = []
        known = segments(self.path)
        size_of_part = self.part_bytes(sum(max(0, stop - start.get(queue, 0)) for queue, stop in end.items()))
        for queue, stop in sorted(end.items()):
            begin = start.get(queue, 0)
            parts = known.get(queue, [])
            if begin < stop and (not parts or parts[0][0] > begin):
                raise ValueError(f"queue {queue}: the log from {begin} to {stop} is no longer there")
            for base, size, file in parts:
                lo, hi = max(begin, base), min(stop, base + size)
                for at in range(lo, hi, size_of_part):
                    to = min(at + size_of_part, hi)
                    made.append(Part(queue, base, file, at - base, to - base, at > lo))
        return made

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        files, _ = _open(self.path)
        with files.open_input_file(partition.file) as file:
            yield from records(file, partition)

    def commit(self, end: dict) -> None:
        pass


def records(file, part: Part) -> Iterator[pa.RecordBatch]:
    """The records that begin within the part; the last one may end behind it."""
    at = part.lo
    rest = b""
    if part.inside:  # a record that begins before belongs to the part before
        at -= 1
    file.seek(at)
    skipping = part.inside
    read = at
    while True:
        block = file.read(BATCH_BYTES)
        read += len(block)
        data = rest + block
        if skipping:
            cut = data.find(b"\n")
            if cut < 0:
                if not block:
                    return
                at, rest = read, b""
                continue
            at, data, skipping = at + cut + 1, data[cut + 1 :], False
        lines = data.split(b"\n")
        rest = lines.pop()
        positions, values = [], []
        for line in lines:
            if at >= part.hi:
                break
            positions.append(at + part.base)
            values.append(line)
            at += len(line) + 1
        if values:
            text = [v.decode("utf-8", "replace") for v in values]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.queue] * len(text)), pa.array(positions, pa.int64()), pa.array(text)],
                names=RECORD.fieldNames(),
            )
        if at >= part.hi or not block:
            return


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return RECORD

    def streamReader(self, schema: T.StructType) -> SegmentReader:
        parts = int(self.options.get("parts", 0))
        return SegmentReader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)), parts)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SegmentSource)


def read_segments_stream(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """queue, position and value of every record, as a stream.

    Parts are not cut smaller than ``split_bytes``.
    """
    register(spark)
    parts = PARTS_PER_CORE * spark.sparkContext.defaultParallelism
    return spark.readStream.format(FORMAT).option("splitbytes", split_bytes).option("parts", parts).load(path)


def append_segments(rows: DataFrame, path: str, order: str) -> None:
    """Add ``queue`` and ``value`` (one line each) as a new segment per queue, in ``order``.

    A queue is written by one task, as a log is; a task that runs again writes its file anew, since
    the positions at which the segments begin are settled before.
    """
    ends = {queue: parts[-1][0] + parts[-1][1] for queue, parts in segments(path).items()}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(path)
        current, out, counts = None, None, {}
        for batch in batches:
            rows = zip(batch.column("queue").to_pylist(), batch.column("value").to_pylist())
            for queue, run in groupby(rows, itemgetter(0)):
                if queue != current:
                    if out:
                        out.close()
                    files.create_dir(f"{root}/{FOLDER}{queue}", recursive=True)
                    out = files.open_output_stream(f"{root}/{FOLDER}{queue}/{ends.get(queue, 0):020}{SUFFIX}")
                    current = queue
                lines = [value for _, value in run]
                out.write("\n".join([*lines, ""]).encode())  # the stream has no buffer of its own
                counts[queue] = counts.get(queue, 0) + len(lines)
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["queue", "n"])

    ordered = rows.select("queue", "value", order).repartition("queue").sortWithinPartitions("queue", order)
    ordered.select("queue", "value").mapInArrow(write, "queue string, n long").agg(F.sum("n")).collect()
