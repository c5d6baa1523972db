"""Tables that streams write batch by batch: change logs with compaction, and pairs of tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tremora.sources.payloads import split_decoded

BATCH = "batch_id"
#: Names that readers of the folder as a whole pass over.
BASE = "_base"


def _folders(spark: SparkSession, path: str, pattern: str) -> dict[int, str]:
    """Sub-folders whose names match, by the number in the name; only those written to the end."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    found = {}
    for status in files.listStatus(root):
        place = status.getPath()
        match = re.fullmatch(pattern, place.getName())
        if match and files.exists(hadoop.Path(place, "_SUCCESS")):
            found[int(match[1])] = place.toString()
    return found


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def batch_folders(spark: SparkSession, path: str) -> dict[int, str]:
    return _folders(spark, path, r"batch_id=(\d+)")


def base_folders(spark: SparkSession, path: str) -> dict[int, str]:
    return _folders(spark, f"{path}/{BASE}", r"upto=(\d+)")


def read_current(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The current rows of a change log: its newest base, and the batches after it.

    What is read is settled by one look at the folder; a compaction that ends meanwhile leaves
    all of it in place.
    """
    bases = base_folders(spark, path)
    newest = max(bases, default=-1)
    parts = []
    if bases:
        base = spark.read.schema(schema).parquet(bases[newest])
        parts.append(base.withColumn(BATCH, F.lit(newest).cast("bigint")))
    later = sorted((n, p) for n, p in batch_folders(spark, path).items() if n > newest)
    if later:
        with_batch = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
        reader = spark.read.schema(with_batch).option("basePath", path)
        parts.append(reader.parquet(*[p for _, p in later]))
    if not parts:
        return spark.createDataFrame([], schema)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    values = [c for c in schema.fieldNames() if c not in keys]
    newest_row = F.max_by(F.struct(*values), BATCH).alias("__row") if values else F.count(F.lit(1)).alias("__n")
    current = rows.groupBy(*keys).agg(newest_row)
    return current.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in schema.fieldNames()])


def compact(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> int | None:
    """Merge all finished batches into a new base; returns the last batch that it holds.

    The base counts once its folder is complete, so readers see the old version or the new one,
    never a mixture, and a compaction that dies leaves nothing that is read. What the base before
    replaced is removed only now, one compaction later: readers that began before still find it.
    """
    batches, bases = batch_folders(spark, path), base_folders(spark, path)
    upto = max(batches, default=-1)
    before = max(bases, default=-1)
    if upto <= before:
        return None
    read_current(spark, path, schema, keys).write.mode("overwrite").parquet(f"{path}/{BASE}/upto={upto}")
    for number, place in batches.items():
        if number <= before:
            _remove(spark, place)
    for number, place in bases.items():
        if number < before:
            _remove(spark, place)
    return upto


def write_changes(path: str, schema: T.StructType, keys: list[str], every: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a folder per batch, and a compaction each time ``every`` have gathered.

    A repeated batch overwrites its own folder; one that a base holds already is not written again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base = max(base_folders(spark, path), default=-1)
        if batch_id <= base:
            return
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if sum(n > base for n in batch_folders(spark, path)) >= every:
            compact(spark, path, schema, keys)

    return write


def changes_to_compacted_table(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: list[str],
    every: int = 50,
    trigger: str | None = None,
    mode: str = "update",
) -> StreamingQuery:
    """changes_to_table with compaction: a reader meets one base and fewer than ``every`` batches.

    Aggregates tell their changes in ``update`` mode; a stateful operator that emits its newest
    rows itself takes ``append``.
    """
    write = write_changes(path, stream.schema, keys, every)
    when = {"processingTime": trigger} if trigger else {"availableNow": True}
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return query.foreachBatch(write).trigger(**when).start()


def decoded_to_tables(
    decoded: DataFrame, good: str, bad: str, checkpoint: str, trigger: str | None = None
) -> StreamingQuery:
    """One stream of decoded payloads to two tables, readings and quarantined payloads, exactly once.

    Each micro-batch is decoded once and held while both are written; the folders carry the
    batch's number, so a batch that is repeated after a failure between the two replaces what it
    left behind.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for part, path in zip(split_decoded(held), (good, bad)):
                part.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        finally:
            held.unpersist()

    when = {"processingTime": trigger} if trigger else {"availableNow": True}
    query = decoded.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return query.foreachBatch(write).trigger(**when).start()


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a table written in folders ``batch_id=...``, without the number."""
    with_batch = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    return spark.read.schema(with_batch).parquet(path).drop(BATCH)
