"""Hard negatives by exact integer scores: Strassen products of tiles, mergeable heaps.

Vectors are scaled and floored to integers; a score is an inner product of two of them. Anchors
are taken in groups of GROUP_BYTES, and each group meets every row, in blocks, without shuffling the
rows: a task multiplies tiles of the group's anchors with tiles of its rows, both int64, by
Strassen's recursion (seven products of half size in place of eight; odd sides are padded with
zeros; only integer additions, so nothing is rounded). From each tile of scores it keeps what
belongs in a heap: first, per anchor, the best rows of its label (positives); then, per anchor
and positive, the best rows of other labels whose score lies in the positive's window. The heaps of
different tasks merge into the heap of all rows by keeping the best of their union, so only heaps are
shuffled, a few rows per task and anchor. What the driver holds of a group has a fixed size.

Every anchor meets every row once for each of the two heaps, which is the size of an exact search;
positives are looked for in the anchors' own label only.

Defined cases: rows without id, label or vector, or with a null or non-finite component, take no
part; nor do vectors whose integer norm squared reaches 2^56, so that no score or multiple of it
can overflow. Vectors of different lengths are padded with zeros; an empty vector is all zeros. Rows
equal in id, label and integer vector count once. Rows that share an id and differ are separate
rows; a row is never its own positive. Ties go to the smaller id. Anchors without positives, and
positives without a negative in their window (for instance those with a negative score), give no rows.
An empty table gives an empty result. Other columns are not read, whatever their names. Labels are
integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.llm.common import bounded_batches
from tremora.session import shared_folder, stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Products with a side up to here are made directly.
LEAF = 32
ROW_TILE, ANCHOR_TILE = 2048, 512
#: What the anchors of one group may take as 64-bit integers.
GROUP_BYTES = 16 << 20
LARGEST_NORM = 2.0**56
NONE = np.iinfo(np.int64).min

RESULT = T.StructType(
    [
        T.StructField("anchor_id", T.LongType()),
        T.StructField("positive_id", T.LongType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("negative_id", T.LongType()),
        T.StructField("positive_score", T.LongType()),
        T.StructField("negative_score", T.LongType()),
    ]
)


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` for int64 matrices, exactly (modulo 2^64)."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    c = np.empty((2 * i, 2 * l), np.int64)
    c[:i, :l] = m1 + m4 - m5 + m7
    c[:i, l:] = m3 + m5
    c[i:, :l] = m2 + m4
    c[i:, l:] = m1 - m2 + m3 + m6
    return c[:m, :n]


class Heaps:
    """The ``k`` best (score, id) of each of ``n`` rows; heaps of parts merge into those of the whole."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), NONE, np.int64)
        self.ids = np.zeros((n, k), np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge a tile, ``scores`` of ``rows`` (distinct) by ``ids`` (ascending); NONE is no entry."""
        floor = self.scores[rows, -1]
        enter = (scores >= floor[:, None]) & (scores != NONE)
        crowded = np.flatnonzero(enter.sum(axis=1) > self.k)
        if len(crowded):  # of these the tile's own k best are enough
            part = scores[crowded]
            least = np.partition(part, -self.k, axis=1)[:, -self.k, None]
            above, equal = part > least, part == least
            room = self.k - above.sum(axis=1)
            enter[crowded] &= above | (equal & (np.cumsum(equal, axis=1) <= room[:, None]))
        at, column = np.nonzero(enter)
        if not len(at):
            return
        changed = np.unique(at)
        owner = np.concatenate([at, np.repeat(changed, self.k)])
        score = np.concatenate([scores[at, column], self.scores[rows[changed]].ravel()])
        name = np.concatenate([ids[column], self.ids[rows[changed]].ravel()])
        order = np.lexsort((name, -score, score == NONE, owner))  # -NONE is NONE: those go last
        owner, score, name = owner[order], score[order], name[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        best = place < self.k
        self.scores[rows[owner[best]], place[best]] = score[best]
        self.ids[rows[owner[best]], place[best]] = name[best]


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    made = np.zeros((len(sizes), width), np.int64)
    made[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = (
        vectors.flatten().to_numpy()
    )
    return made


class Group:
    """One group of anchors, and, once they are known, the windows of their positives."""

    def __init__(self, table: pa.Table, width: int):
        table = table.combine_chunks()
        column = lambda n: table.column(n).to_numpy()
        self.width = width
        self.ids, self.labels, self.keys = column("vec_id"), column("label"), column("key")
        vectors = table.column("vector").combine_chunks()
        self.vectors = matrix(vectors, width)
        self.positives: Heaps | None = None

    def __len__(self) -> int:
        return len(self.ids)

    def tiles(self, batches: Iterator[pa.RecordBatch]):
        """Ids, labels, keys and vectors of rows, ordered by id within a tile."""
        for batch in batches:
            for start in range(0, batch.num_rows, ROW_TILE):
                part = batch.slice(start, ROW_TILE)
                ids = part.column("vec_id").to_numpy()
                order = np.argsort(ids, kind="stable")
                values = [part.column(n).to_numpy()[order] for n in ("label", "key")]
                yield ids[order], *values, matrix(part.column("vector"), self.width)[order]

    def best_positives(self, batches: Iterator[pa.RecordBatch], k: int) -> Heaps:
        heaps = Heaps(len(self), k)
        for ids, labels, keys, vectors in self.tiles(batches):
            for label in np.unique(labels):
                own = np.flatnonzero(labels == label)
                mine = np.flatnonzero(self.labels == label)
                for at in range(0, len(mine), ANCHOR_TILE):
                    rows = mine[at : at + ANCHOR_TILE]
                    scores = strassen(self.vectors[rows], vectors[own].T)
                    itself = (self.ids[rows][:, None] == ids[own]) & (self.keys[rows][:, None] == keys[own])
                    heaps.add(rows, np.where(itself, NONE, scores), ids[own])
        return heaps

    def best_negatives(self, batches: Iterator[pa.RecordBatch], k: int, low: int, high: int) -> list[Heaps]:
        """Heaps for each place among the positives."""
        wanted = self.positives.scores
        known = wanted != NONE
        wanted = np.where(known, wanted, 0)
        least, most = -(-low * wanted // 100), high * wanted // 100
        heaps = [Heaps(len(self), k) for _ in range(wanted.shape[1])]
        for ids, labels, _, vectors in self.tiles(batches):
            for at in range(0, len(self), ANCHOR_TILE):
                rows = np.arange(at, min(at + ANCHOR_TILE, len(self)))
                scores = strassen(self.vectors[rows], vectors.T)
                scores[self.labels[rows][:, None] == labels] = NONE
                for place, heap in enumerate(heaps):
                    some = known[rows, place]
                    lo, hi = least[rows, place][:, None], most[rows, place][:, None]
                    inside = some[:, None] & (scores >= lo) & (scores <= hi)
                    if inside.any():
                        heap.add(rows, np.where(inside, scores, NONE), ids)
        return heaps


def usable(df: DataFrame, anchors: Column, scale: int = SCALE) -> DataFrame:
    """vec_id, label, vector (integers), key, anchor of the rows that take part, each once."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = (
        df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
        .select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), scaled.alias("vector"), anchors.alias("anchor"))
        .where(norm < LARGEST_NORM)
        # Below that norm every component fits in 32 bits.
        .withColumn("vector", F.col("vector").cast("array<int>"))
    )
    key = F.xxhash64("vec_id", "label", "vector")
    return rows.groupBy("vec_id", "label", "vector").agg(F.coalesce(F.bool_or("anchor"), F.lit(False)).alias("anchor")).withColumn("key", key)


def hard_negatives(
    df: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """For each anchor and positive the best ``negatives`` rows within the positive's window.

    ``df`` has vec_id, label and embedding. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.
    """
    spark = df.sparkSession
    bounded_batches(df)
    rows = stored(usable(df, anchors), "negative-rows")
    size = rows.agg(F.max(F.size("vector")).alias("width"), F.count_if("anchor").alias("n")).first()
    path = shared_folder(spark, "negatives")
    per_group = max(1, GROUP_BYTES // (8 * max(1, size["width"] or 0)))
    groups = -(-size["n"] // per_group) if size["n"] else 0
    spark.createDataFrame([], RESULT).write.parquet(path)
    for number in range(groups):
        chosen = rows.where("anchor").where(F.pmod("key", F.lit(groups)) == number)
        group = Group(chosen.select("vec_id", "label", "key", "vector").toArrow(), size["width"])
        group.positives = _positives(rows, group, positives)
        _negatives(rows, group, negatives, low, high).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


def _positives(rows: DataFrame, group: Group, k: int) -> Heaps:
    """The heaps of all rows, merged from those of the tasks."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = shared.value
        heaps = group.best_positives(batches, k)
        anchor, place = np.nonzero(heaps.scores != NONE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor), pa.array(heaps.scores[anchor, place]), pa.array(heaps.ids[anchor, place])],
            names=["anchor", "score", "id"],
        )

    parts = rows.select("vec_id", "label", "key", "vector").mapInArrow(run, "anchor long, score long, id long")
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    merged = parts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).toArrow()
    heaps = Heaps(len(group), k)
    anchor, place = merged.column("anchor").to_numpy(), merged.column("place").to_numpy() - 1
    heaps.scores[anchor, place] = merged.column("score").to_numpy()
    heaps.ids[anchor, place] = merged.column("id").to_numpy()
    shared.destroy()
    return heaps


def _negatives(rows: DataFrame, group: Group, k: int, low: int, high: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = shared.value
        for place, heaps in enumerate(group.best_negatives(batches, k, low, high)):
            anchor, entry = np.nonzero(heaps.scores != NONE)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor),
                    pa.array(np.full(len(anchor), place)),
                    pa.array(group.ids[anchor]),
                    pa.array(group.positives.ids[anchor, place]),
                    pa.array(group.positives.scores[anchor, place]),
                    pa.array(heaps.scores[anchor, entry]),
                    pa.array(heaps.ids[anchor, entry]),
                ],
                names=["anchor", "place", "anchor_id", "positive_id", "positive_score", "negative_score", "negative_id"],
            )

    schema = (
        "anchor long, place long, anchor_id long, positive_id long, positive_score long,"
        " negative_score long, negative_id long"
    )
    parts = rows.select("vec_id", "label", "key", "vector").mapInArrow(run, schema)
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(RESULT.names)
