"""Text files that roll by size, age and idle time, from a stream.

What a file will hold gathers in the state of the query, per slot: lines of a slot are kept until the
next one would pass ``max_bytes``, until ``max_age_ms`` after the first of them, or until no line has
come for ``idle_ms``. Then they leave the state as one row, which becomes one file. Times are those of
the micro-batches, so files roll with the trigger after the limit. Slots are filled in parallel by a
hash of the line; a slot's lines keep the order in which they came.

A file is named by its slot and number in that slot, both from the state, and is moved to its
name when complete. A micro-batch that is repeated after a failure has the same times and state and so
writes the same files again: none twice, none in part. Files are written by the tasks through Arrow: the path is
local, mounted, or a store that Arrow knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tremora.streaming.stateful import stateful

# The published limits of the rolling policy.
MAX_BYTES, MAX_AGE_MS, IDLE_MS = 1 << 20, 30_000, 10_000
FILE = T.StructType(
    [
        T.StructField("slot", T.IntegerType()),
        T.StructField("number", T.LongType()),
        T.StructField("content", T.StringType()),
    ]
)


class Rolling(StatefulProcessor):
    """The lines of a slot's next file, and when the first and the last of them came."""

    def __init__(self, max_bytes: int, max_age_ms: int, idle_ms: int):
        self.limits = (max_bytes, max_age_ms, idle_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "line string")
        self.file = handle.getValueState("file", "number bigint, bytes bigint, opened bigint, touched bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        max_bytes, max_age_ms, idle_ms = self.limits
        now = timerValues.getCurrentProcessingTimeInMs()
        number, size, opened, _ = self.file.get() or (0, 0, None, None)
        made, fresh = [], []
        for frame in rows:
            for line in frame["line"].tolist():
                more = len(line.encode()) + 1
                if size and size + more > max_bytes:
                    made.append((key[0], number, self._content(fresh)))
                    number, size, opened, fresh = number + 1, 0, None, []
                fresh.append(line)
                size += more
                opened = now if opened is None else opened
        if fresh:
            self.lines.appendList([(line,) for line in fresh])
        self.file.update((number, size, opened, now))
        if size:
            self.handle.registerTimer(opened + max_age_ms)
            self.handle.registerTimer(now + idle_ms)
        yield pd.DataFrame(made, columns=FILE.fieldNames())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, max_age_ms, idle_ms = self.limits
        number, size, opened, touched = self.file.get() or (0, 0, None, None)
        at = expiredTimerInfo.getExpiryTimeInMs()
        # Timers of files that have rolled, and of lines that others followed, find nothing due.
        if size and (at >= opened + max_age_ms or at >= touched + idle_ms):
            content = self._content([])
            self.file.update((number + 1, 0, None, None))
            yield pd.DataFrame([(key[0], number, content)], columns=FILE.fieldNames())

    def _content(self, fresh: list[str]) -> str:
        """The lines in the state, which is emptied, and then ``fresh`` ones."""
        held = [row[0] for row in self.lines.get()]
        self.lines.clear()
        return "".join(f"{line}\n" for line in (*held, *fresh))

    def close(self) -> None:
        pass


def rolled(
    stream: DataFrame,
    line: str,
    slots: int = 4,
    max_bytes: int = MAX_BYTES,
    max_age_ms: int = MAX_AGE_MS,
    idle_ms: int = IDLE_MS,
) -> DataFrame:
    """slot, number and content of each file to be written; null lines are left out.

    No file is larger than ``max_bytes``, unless a single line is.
    """
    lines = stream.where(F.col(line).isNotNull()).select(
        F.pmod(F.xxhash64(line), F.lit(slots)).cast("int").alias("slot"), F.col(line).alias("line")
    )
    return stateful(lines, ["slot"], Rolling(max_bytes, max_age_ms, idle_ms), FILE, "ProcessingTime")


def write_rolled(files: DataFrame, path: str, checkpoint: str, every: str = "5 seconds") -> StreamingQuery:
    """Write each row of ``rolled`` as a file ``part-<slot>-<number>.csv`` below ``path``."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        n = 0
        for batch in batches:
            for slot, number, content in zip(*(c.to_pylist() for c in batch.columns)):
                store.create_dir(root, recursive=True)
                name = f"part-{slot:05}-{number:08}.csv"
                with store.open_output_stream(f"{root}/.{name}") as out:
                    out.write(content.encode())
                store.move(f"{root}/.{name}", f"{root}/{name}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(FILE.fieldNames()).mapInArrow(save, "n long").agg(F.sum("n")).collect()

    query = files.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return query.foreachBatch(write).trigger(processingTime=every).start()
