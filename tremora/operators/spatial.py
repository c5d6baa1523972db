"""Grid statistics and neighbourhood scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.functions.grid import DEFAULT_CELL, cell_key, cell_x, cell_y, offsets
from tremora.operators.chunks import PIECE, PiecePlan, plan_pieces
from tremora.schemas import READING_ORDER

CELL = ["gx", "gy"]
BLOCK = ["bx", "by"]
BLOCK_CELLS = 8  # cells along one side of a block
SUM, COUNT, HOME = "__sum", "__n", "__home"


def with_cell(readings: DataFrame, size: float = DEFAULT_CELL) -> DataFrame:
    return readings.withColumns({"gx": cell_x(size), "gy": cell_y(size)})


def with_grid(readings: DataFrame, size: float = DEFAULT_CELL) -> DataFrame:
    """Add the cell (gx, gy) of a reading and its grid_key."""
    return with_cell(readings, size).withColumn("grid_key", cell_key())


def grid_agg(
    readings: DataFrame, size: float = DEFAULT_CELL, by_sensor: bool = False
) -> DataFrame:
    """Count, amplitude sum/max/min/mean, P and S counts and last update per cell."""
    keys = (["sensor_id"] if by_sensor else []) + CELL
    amplitude = F.col("seismic_amplitude").cast("double")
    return _finish(
        with_cell(readings, size)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("record_count"),
            F.sum(amplitude).alias("sum_amplitude"),
            F.max(amplitude).alias("max_amplitude"),
            F.min(amplitude).alias("min_amplitude"),
            F.count_if(F.col("phase_type").eqNullSafe("P")).alias("p_wave_count"),
            F.count_if(F.col("phase_type").eqNullSafe("S")).alias("s_wave_count"),
            F.max("collect_timestamp").alias("last_update"),
        ),
        keys,
    )


def merge_grids(partials: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Combine grid statistics that were computed separately, for instance per day."""
    keys = keys or CELL
    return _finish(partials.groupBy(*keys).agg(*_merged()), keys)


def neighbour_keys(cells: DataFrame, radius: int = 1) -> DataFrame:
    """One row per cell and surrounding cell, the centre left out."""
    return (
        cells.select(*CELL, F.explode(offsets(radius, with_centre=False)).alias("o"))
        .select(
            *CELL,
            (F.col("gx") + F.col("o.dx")).alias("nx"),
            (F.col("gy") + F.col("o.dy")).alias("ny"),
        )
        .withColumn("neighbour_key", cell_key("nx", "ny"))
    )


#: Up to this radius a cell is sent to all cells around it; beyond, along one axis at a time.
NEAR = 2


def neighbourhood_agg(grids: DataFrame, radius: int = 1) -> DataFrame:
    """Statistics of each existing cell together with its surrounding cells.

    Every cell sends itself to the cells around it and one hash aggregation adds them
    up. A target nobody stands in has no own copy and is dropped, so no join is needed.
    With larger radii that would be (2r+1)^2 copies of each cell. All the statistics can be added
    up in two steps, though, so cells are then summed along columns first (2r+1 copies), and each
    existing cell gathers those sums along its row (2r+1 look-ups).
    """
    if radius > NEAR:
        return _separable(grids, radius)
    sent = (
        grids.withColumn("o", F.explode(offsets(radius, with_centre=True)))
        .withColumn("is_centre", (F.col("o.dx") == 0) & (F.col("o.dy") == 0))
        .withColumns({"gx": F.col("gx") + F.col("o.dx"), "gy": F.col("gy") + F.col("o.dy")})
    )
    merged = sent.groupBy(*CELL).agg(*_merged(), F.bool_or("is_centre").alias("exists"))
    return _finish(merged.where("exists"), CELL)


def _separable(grids: DataFrame, radius: int) -> DataFrame:
    steps = F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("__step")
    measures = [c for c in grids.columns if c not in (*CELL, "grid_key", "avg_amplitude")]
    sent = grids.select("gx", "gy", *measures, steps)
    columns = sent.withColumn("gy", F.col("gy") + F.col("__step")).groupBy(*CELL).agg(*_merged())
    # The same cell in two grids (merged or not) is one centre.
    centres = grids.select("gx", F.col("gy").alias("gy")).distinct()
    asked = centres.select(F.col("gx").alias("__x"), "gy", steps).withColumn("gx", F.col("__x") + F.col("__step"))
    found = asked.join(columns, CELL).groupBy(F.col("__x"), "gy").agg(*_merged())
    return _finish(found.withColumnRenamed("__x", "gx"), CELL)


def latest_grids(grids: DataFrame, n: int = 1000) -> DataFrame:
    """The ``n`` most recently updated cells."""
    return grids.orderBy(F.desc("last_update"), "grid_key").limit(n)


def sent_to_blocks(readings: DataFrame, size: float, radius: int) -> DataFrame:
    """Each reading once for every block (bx, by) in which it counts; HOME marks its own."""
    side = F.lit(BLOCK_CELLS)

    def blocks(axis: str) -> Column:
        first = F.floor((F.col(axis) - F.lit(radius)) / side)
        last = F.floor((F.col(axis) + F.lit(radius)) / side)
        return F.explode(F.sequence(first, last))

    home = (F.col("bx") == F.floor(F.col("gx") / side)) & (
        F.col("by") == F.floor(F.col("gy") / side)
    )
    placed = with_cell(readings, size).where("gx IS NOT NULL AND gy IS NOT NULL")
    return placed.withColumn("bx", blocks("gx")).withColumn("by", blocks("gy")).withColumn(HOME, home)


def plan_blocks(
    readings: DataFrame, size: float = DEFAULT_CELL, radius: int = 1, **limits: int
) -> PiecePlan:
    """Look for blocks with too many rows for one task and cut them along time.

    Counts what a block receives, copies from the blocks around it included.
    """
    return plan_pieces(sent_to_blocks(readings, size, radius), BLOCK, READING_ORDER[0], **limits)


def score_spatial(
    readings: DataFrame,
    size: float = DEFAULT_CELL,
    radius: int = 1,
    plan: PiecePlan | None = None,
) -> DataFrame:
    """Score each reading against the running mean of its neighbourhood.

    neighbourhood_avg is the mean over all readings in the (2r+1)^2 cells around it up
    to and including this one, in (collect_timestamp, event_id) order.

    A reading contributes to (2r+1)^2 cells. Sending it to each of them through the
    exchange would multiply the shuffle by nine, so readings travel to blocks of
    8 x 8 cells instead (1.56 copies on average for r = 1; a copy outside its own block
    carries the amplitude only). A block's readings then stream in order past running sums per
    cell. ``plan`` (from plan_blocks) cuts busy blocks into time pieces; each piece
    starts with one carry row per cell that holds the sum and count of all earlier
    pieces. Readings without a position have no neighbourhood and are left out. Sums are
    doubles: cut and whole blocks may differ in the last bits.
    """
    order = list(READING_ORDER)
    columns = readings.columns
    sent = sent_to_blocks(readings, size, radius)
    plan = plan or PiecePlan(tuple(BLOCK), order[0])
    payload = [c for c in columns if c not in order]
    sent = plan.assign(sent).select(
        *BLOCK,
        PIECE,
        *CELL,
        *order,
        F.col("seismic_amplitude").cast("double").alias(SUM),
        F.lit(1).cast("bigint").alias(COUNT),
        HOME,
        *[F.when(F.col(HOME), F.col(c)).alias(c) for c in payload],
    )
    if not plan.is_whole:
        sent = sent.unionByName(_carry_rows(plan.only_cut(sent), radius), allowMissingColumns=True)

    task = BLOCK if plan.is_whole else [*BLOCK, PIECE]
    ordered = sent.repartition(*task).sortWithinPartitions(
        *BLOCK, PIECE, *[F.asc_nulls_first(c) for c in order]
    )
    schema = T.StructType(
        [*readings.schema.fields, T.StructField("neighbourhood_avg", T.DoubleType())]
    )
    average = F.col("neighbourhood_avg")
    return ordered.mapInArrow(_running_means(columns, radius), schema).withColumn(
        "spatial_ratio",
        F.when(average > 0, F.col("seismic_amplitude").cast("double") / average).otherwise(
            F.lit(0.0)
        ),
    )


def running_means(x, y, runs, amounts, weights, carry, scored, sums, counts, radius: int):
    """Means of the ``scored`` rows, and the sums and counts that rows leave in their block's cells.

    Rows are in order; ``x``, ``y`` are their cells within the block, ``runs`` numbers the blocks
    that follow each other among them, and ``sums``, ``counts`` are what came before in the
    first one. Each row is spread over the cells it counts in and summed up per cell in row order.
    A ``carry`` row already is a total and stays in its cell. The sums returned are the last block's.
    """
    side = BLOCK_CELLS
    span = np.arange(-radius, radius + 1)
    dx, dy = (d.ravel() for d in np.meshgrid(span, span, indexing="ij"))
    centre = len(dx) // 2
    # Targets of each row, row by row, so that every cell sees rows in order.
    tx, ty = x[:, None] + dx, y[:, None] + dy
    inside = (tx >= 0) & (tx < side) & (ty >= 0) & (ty < side)
    inside[carry] = False
    inside[carry, centre] = True
    cell = (runs[:, None] * side * side + tx * side + ty)[inside]
    repeats = inside.sum(axis=1)
    by_cell = pd.DataFrame(
        {SUM: np.repeat(amounts, repeats), COUNT: np.repeat(weights.astype(float), repeats)}
    ).groupby(cell, sort=False)
    running = by_cell.cumsum()
    totals = by_cell.sum()

    # Where each scored row meets its own cell, and what came before the rows there.
    own = np.zeros(inside.shape, bool)
    own[scored, centre] = True
    at = own[inside]
    own_cell = cell[at]
    total, n = running[SUM].to_numpy()[at], running[COUNT].to_numpy()[at]
    goes_on = own_cell < side * side
    total[goes_on] += sums[own_cell[goes_on]]
    n[goes_on] += counts[own_cell[goes_on]]

    offset = runs[-1] * side * side
    if offset:
        sums, counts = np.zeros(side * side), np.zeros(side * side)
    else:
        sums, counts = sums.copy(), counts.copy()
    codes = totals.index.to_numpy()
    in_last = codes >= offset
    sums[codes[in_last] - offset] += totals[SUM].to_numpy()[in_last]
    counts[codes[in_last] - offset] += totals[COUNT].to_numpy()[in_last]
    return total / n, sums, counts


def _running_means(columns: list[str], radius: int):
    """Means over rows sorted by (block, piece, time, id), vectorised per Arrow batch.

    Between batches only the sums of the block in progress are kept: one number pair per
    cell. HOME is true for a reading to score, false for a copy, NULL for a carry row.
    """
    side = BLOCK_CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums, counts = None, np.zeros(side * side), np.zeros(side * side)
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.column_stack([batch.column(c).to_numpy() for c in (*BLOCK, PIECE)])
            home = batch.column(HOME)
            scored = home.fill_null(False).to_numpy(zero_copy_only=False)
            starts = np.append(True, (group[1:] != group[:-1]).any(axis=1))
            if tuple(group[0]) != current:
                sums, counts = np.zeros(side * side), np.zeros(side * side)
            means, sums, counts = running_means(
                batch.column("gx").to_numpy() - group[:, 0] * side,
                batch.column("gy").to_numpy() - group[:, 1] * side,
                np.cumsum(starts) - 1,
                batch.column(SUM).to_numpy(),
                batch.column(COUNT).to_numpy(),
                home.is_null().to_numpy(zero_copy_only=False),
                scored,
                sums,
                counts,
                radius,
            )
            current = tuple(group[-1])
            output = batch.select(columns).filter(pa.array(scored))
            yield output.append_column("neighbourhood_avg", pa.array(means))

    return run


def spatial_anomaly(threshold: float = 0.5) -> Column:
    """Well above the neighbourhood mean; low values are not anomalies here."""
    return F.col("spatial_ratio") > 1 + threshold


def regional_anomaly(threshold: float = 0.5) -> Column:
    """Second formula: amplitude / (mean - amplitude) > 1 + threshold; false if they are equal."""
    amplitude = F.col("seismic_amplitude").cast("double")
    rest = F.col("neighbourhood_avg") - amplitude
    return F.when(rest == 0, F.lit(False)).otherwise(amplitude / rest > 1 + threshold)


def _carry_rows(cut: DataFrame, radius: int) -> DataFrame:
    """Per cut block, piece and cell: sum and count over the cell's neighbourhood in all
    earlier pieces. At most 64 rows per piece, however many readings there are."""
    totals = [F.sum(SUM).alias(SUM), F.sum(COUNT).alias(COUNT)]
    side = F.lit(BLOCK_CELLS)
    inside = (F.floor(F.col("gx") / side) == F.col("bx")) & (
        F.floor(F.col("gy") / side) == F.col("by")
    )
    per_target = (
        cut.groupBy(*BLOCK, PIECE, *CELL)
        .agg(*totals)
        .withColumn("o", F.explode(offsets(radius, with_centre=True)))
        .withColumns({"gx": F.col("gx") + F.col("o.dx"), "gy": F.col("gy") + F.col("o.dy")})
        .where(inside)
        .groupBy(*BLOCK, PIECE, *CELL)
        .agg(*totals)
    )
    # A reading always counts in its own cell, so a piece with readings to score in a cell
    # has a total for it, and carrying each running total to the next one is enough.
    by_cell = Window.partitionBy(*BLOCK, *CELL).orderBy(PIECE)
    before = by_cell.rowsBetween(Window.unboundedPreceding, -1)
    return (
        per_target.withColumns({SUM: F.sum(SUM).over(before), COUNT: F.sum(COUNT).over(before)})
        .where(F.col(COUNT).isNotNull())
        .select(*BLOCK, PIECE, *CELL, SUM, COUNT, F.lit(None).cast("boolean").alias(HOME))
    )


def _merged() -> list[Column]:
    """Sums stay sums, extremes stay extremes."""
    sums = ["record_count", "sum_amplitude", "p_wave_count", "s_wave_count"]
    tops = ["max_amplitude", "last_update"]
    return [
        *[F.sum(c).alias(c) for c in sums],
        *[F.max(c).alias(c) for c in tops],
        F.min("min_amplitude").alias("min_amplitude"),
    ]


def _finish(grids: DataFrame, keys: list[str]) -> DataFrame:
    count, total = F.col("record_count"), F.col("sum_amplitude")
    return grids.select(
        *keys,
        cell_key().alias("grid_key"),
        "record_count",
        "sum_amplitude",
        "max_amplitude",
        "min_amplitude",
        F.when(count > 0, total / count).otherwise(F.lit(0.0)).alias("avg_amplitude"),
        "p_wave_count",
        "s_wave_count",
        "last_update",
    )
