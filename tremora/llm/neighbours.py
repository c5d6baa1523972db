"""Approximate nearest neighbours by cosine with an inverted multi-index.

Unit vectors are cut into two halves, each quantised with its own codebook; a vector's cell is
its pair of centroids. A query walks the pairs in order of their summed squared distance, by a
heap over the two sorted lists, until the cells passed hold ``share`` of its candidates and k ids
at least, or no cell is left. Candidates are distinct rows of other ids. On the way, cells are
passed over that provably hold none of the k nearest: each cell knows how far its vectors lie from
its centroids, so the triangle inequality bounds a query's distance to them from below, and its
distance to the k nearest from above. Where vectors form clusters few cells are left to visit; where
they have no structure, ``share`` decides. Vectors of the visited cells are reranked by the cosine of
the original vectors in double precision.

Codebooks are fitted on a bounded sample (``SAMPLE`` vectors, chosen by a hash of their ids);
every vector is indexed, once if it is repeated. The vectors of one first-half centroid form a slab;
slabs are cut into blocks of about ``BLOCK`` vectors by a hash of id and vector, and so are the
queries that visit it, so a task compares at most one block with another by a matrix product and
passes on the best k of each query, also where one id or one vector has a third of the rows.

Defined cases: vectors that are null, empty, zero, or hold a null, NaN or infinity take no part,
neither do rows without id or vectors of another than the most frequent dimension. A query's own
row is every row of its id. Rows equal in id and vector count once. Ties go to the smaller id.
Further columns are ignored. Without vectors the result is empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.llm.common import append_columns, small
from tremora.session import stored

CENTROIDS, SAMPLE, ROUNDS = 32, 20_000, 12
SHARE = 0.6
BLOCK = 4096
MOST_BROADCAST = 100_000
SLACK = 1e-9  # how far a matrix product may be from the exact cosine
ROUNDING = 1e-6  # how far a distance to a centroid may be from the exact one


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part."""
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", vector.alias("embedding")).where(
        F.col("vec_id").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("embedding") == (sizes[0]["n"] if sizes else 0))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(axis=1)


def _halves(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = (vectors.shape[1] + 1) // 2
    return vectors[:, :middle], vectors[:, middle:]


def fit_codebooks(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """k-means on either half of a sample of unit vectors, from spread-out starts (k-means++)."""
    random = np.random.default_rng(5)
    books = []
    for points in _halves(sample):
        centroids = points[random.integers(len(points))][None].copy()
        off = np.maximum(_distances(points, centroids)[:, 0], 0)
        while len(centroids) < CENTROIDS and off.sum() > 0:
            start = points[random.choice(len(points), p=off / off.sum())][None]
            centroids = np.concatenate([centroids, start])
            off = np.minimum(off, np.maximum(_distances(points, start)[:, 0], 0))
            off[(points == start).all(axis=1)] = 0
        for _ in range(ROUNDS):
            nearest = _distances(points, centroids).argmin(axis=1)
            for k in range(len(centroids)):
                if (nearest == k).any():
                    centroids[k] = points[nearest == k].mean(axis=0)
        books.append(centroids)
    return books[0], books[1]


def useless(first: np.ndarray, second: np.ndarray, ids: np.ndarray, radii: np.ndarray, k: int) -> np.ndarray:
    """Cells all of whose vectors are farther than the ``k`` nearest ids can be.

    ``first``, ``second`` are a query's squared distances to the centroids, ``ids`` the other ids
    in each cell, ``radii`` the largest distances of a cell's vectors from its two centroids.
    """
    to = np.sqrt(np.maximum(first, 0))[:, None], np.sqrt(np.maximum(second, 0))[None, :]
    most = np.hypot(to[0] + radii[..., 0], to[1] + radii[..., 1])
    least = np.hypot(np.maximum(0, to[0] - radii[..., 0]), np.maximum(0, to[1] - radii[..., 1]))
    order = np.argsort(most, axis=None)
    enough = np.searchsorted(np.cumsum(ids.ravel()[order]), k)
    if enough >= len(order):
        return np.zeros(ids.shape, bool)
    return least > most.ravel()[order[enough]] + ROUNDING


def walk(
    first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: np.ndarray, skip: np.ndarray | None = None
) -> Iterator[tuple[int, int]]:
    """Pairs of centroids by increasing ``first[a] + second[b]`` until ``wanted`` (candidates and
    ids) of ``sizes[a, b]`` are passed. Pairs marked in ``skip`` are left out, and give no ids."""
    rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap = [(first[rows[0]] + second[columns[0]], 0, 0)]
    passed = np.zeros_like(wanted)
    while heap and (passed < wanted).any():
        _, i, j = heapq.heappop(heap)
        a, b = int(rows[i]), int(columns[j])
        if skip is not None and skip[a, b]:
            passed = passed + (sizes[a, b, 0], 0)
        else:
            passed = passed + sizes[a, b]
            yield a, b
        if j + 1 < len(columns):
            heapq.heappush(heap, (first[a] + second[columns[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(rows):
            heapq.heappush(heap, (first[rows[i + 1]] + second[b], i + 1, 0))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64)


def with_cells(rows: DataFrame, books) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(books)
    fields = [T.StructField("slab", T.IntegerType()), T.StructField("cell", T.IntegerType())]
    fields += [T.StructField("off_slab", T.DoubleType()), T.StructField("off_cell", T.DoubleType())]

    def start():
        def work(batch: pa.RecordBatch):
            halves = _halves(_unit(_matrix(batch.column("embedding"))))
            near = [_distances(h, b).argmin(axis=1) for h, b in zip(halves, shared.value)]
            off = [np.sqrt(((h - b[n]) ** 2).sum(axis=1)) for h, b, n in zip(halves, shared.value, near)]
            return {
                "slab": pa.array(near[0], pa.int32()), "cell": pa.array(near[1], pa.int32()),
                "off_slab": pa.array(off[0]), "off_cell": pa.array(off[1]),
            }

        return work

    return append_columns(rows, start, fields)


def with_visits(
    queries: DataFrame, books, sizes: np.ndarray, radii: np.ndarray, share: float, k: int
) -> DataFrame:
    """Add visits: for each slab that a query enters, the cells (bits) it looks at there.

    ``sizes`` has the distinct rows and ids of each cell, ``radii`` their largest distances from its
    centroids; own has the rows of the query's id by
    cell, null if that is one row.
    """
    shared = queries.sparkSession.sparkContext.broadcast((books, sizes, radii))
    kind = T.ArrayType(T.StructType([T.StructField("slab", T.IntegerType()), T.StructField("cells", T.LongType())]))

    def start():
        books, sizes, radii = shared.value
        sizes = sizes.copy()
        total = sizes[..., 0].sum()

        def work(batch: pa.RecordBatch):
            halves = _halves(_unit(_matrix(batch.column("embedding"))))
            made = []
            cells = [batch.column(c).to_pylist() for c in ("slab", "cell", "own")]
            for first, second, *mine in zip(*(_distances(h, b) for h, b in zip(halves, books)), *cells):
                own = mine[2] or [{"slab": mine[0], "cell": mine[1], "n": 1}]
                for o in own:
                    sizes[o["slab"], o["cell"]] -= (o["n"], 1)
                wanted = np.array([share * (total - sum(o["n"] for o in own)), k])
                bits: dict[int, int] = {}
                skip = useless(first, second, sizes[..., 1], radii, k)
                for a, b in walk(first, second, sizes, wanted, skip):
                    bits[a] = bits.get(a, 0) | 1 << b
                for o in own:
                    sizes[o["slab"], o["cell"]] += (o["n"], 1)
                made.append([{"slab": a, "cells": c} for a, c in bits.items()])
            return {"visits": pa.array(made, pa.list_(pa.struct([("slab", pa.int32()), ("cells", pa.int64())])))}

        return work

    return append_columns(queries, start, [T.StructField("visits", kind)])


def _rerank(k: int):
    def compare(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        )
        if vectors.empty or queries.empty:
            return empty
        rows, asked = np.stack(vectors["embedding"]), np.stack(queries["embedding"])
        ids, cells = vectors["vec_id"].to_numpy(), vectors["cell"].to_numpy()
        about = _unit(asked) @ _unit(rows).T
        seen = (queries["cells"].to_numpy()[:, None] >> cells[None, :]) & 1 == 1
        about[~seen | (queries["query_id"].to_numpy()[:, None] == ids[None, :])] = -np.inf
        norms = np.sqrt((rows * rows).sum(axis=1))
        found = []
        for n, query_id in enumerate(queries["query_id"].to_numpy()):
            own, many = asked[n], k
            while True:
                bound = np.partition(about[n], -many)[-many] if len(ids) > many else -np.inf
                near = np.flatnonzero((about[n] >= bound - SLACK) & (about[n] > -np.inf))
                exact = (rows[near] * own).sum(axis=1) / (norms[near] * np.sqrt((own * own).sum()))
                best = np.lexsort((ids[near], -exact))
                # Repeated rows count once, so look further where they fill the first places.
                again = (np.diff(ids[near][best]) == 0) & (np.diff(exact[best]) == 0)
                best = best[~np.append(False, again)[: len(best)]][:k]
                if len(best) == k or many >= len(ids):
                    break
                many *= 4
            found.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[near][best], "score": exact[best]}))
        return pd.concat(found, ignore_index=True) if found else empty

    return compare


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows found for each query row.

    ``is_query`` is a condition on vec_id.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    total = rows.count()
    output = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], output)
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(draw < SAMPLE / total).limit(2 * SAMPLE).collect() or rows.limit(1).collect()
    books = fit_codebooks(_unit(np.array([r["embedding"] for r in sorted(chosen)])))
    index = stored(with_cells(rows.dropDuplicates(["vec_id", "embedding"]), books), "multi-index")
    by_id = index.groupBy("slab", "cell", "vec_id").agg(
        F.count("*").alias("n"), F.max("off_slab").alias("off_slab"), F.max("off_cell").alias("off_cell")
    )
    held = np.zeros(len(books[0]), np.int64)
    sizes = np.zeros((len(books[0]), len(books[1]), 2), np.int64)
    radii = np.zeros(sizes.shape)
    cells = by_id.groupBy("slab", "cell").agg(
        F.sum("n").alias("n"), F.count("*").alias("ids"), F.max("off_slab").alias("off_slab"), F.max("off_cell").alias("off_cell")
    )
    for r in cells.collect():
        sizes[r["slab"], r["cell"]] = r["n"], r["ids"]
        radii[r["slab"], r["cell"]] = r["off_slab"], r["off_cell"]
    index = index.drop("off_slab", "off_cell")
    for r in index.groupBy("slab").count().collect():
        held[r["slab"]] = r["count"]

    own = by_id.where(is_query).groupBy("vec_id").agg(
        F.collect_list(F.struct("slab", "cell", "n")).alias("own"), F.sum("n").alias("rows")
    )
    own = small(stored(own.where("rows > 1").drop("rows"), "repeated-ids"), MOST_BROADCAST)
    asking = index.where(is_query).select("vec_id", "embedding", "slab", "cell").join(own, "vec_id", "left")
    queries = with_visits(asking, books, sizes, radii, share, k)
    visits = queries.select(F.col("vec_id").alias("query_id"), "embedding", F.explode("visits").alias("v"))
    visits = stored(visits.select("query_id", "embedding", "v.slab", "v.cells"), "visits")
    asked = {r["slab"]: r["count"] for r in visits.groupBy("slab").count().collect()}

    def blocks(counts: dict[int, int]) -> Column:
        """Number of blocks of a row's slab."""
        table = F.array(*[F.lit(-(-counts.get(s, 0) // BLOCK) or 1) for s in range(len(books[0]))])
        return F.get(table, F.col("slab"))

    row_blocks = blocks({s: int(n) for s, n in enumerate(held)})
    query_blocks = blocks(asked)
    pairs = (("vec_id", row_blocks), ("query_id", query_blocks))
    part = [F.pmod(F.xxhash64(c, "embedding"), n).cast("int") for c, n in pairs]
    every = [F.explode(F.sequence(F.lit(0), n - 1)) for n in (query_blocks, row_blocks)]
    left = index.withColumn("row_block", part[0]).withColumn("query_block", every[0])
    right = visits.withColumn("query_block", part[1]).withColumn("row_block", every[1])
    group = ["slab", "row_block", "query_block"]
    found = (
        left.groupBy(*group)
        .cogroup(right.groupBy(*group))
        .applyInPandas(_rerank(k), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
