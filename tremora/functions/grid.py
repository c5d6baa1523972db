"""Expressions over the square longitude/latitude grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_CELL = 0.01  # degrees


def cell_x(size: float = DEFAULT_CELL) -> Column:
    return F.floor(F.col("longitude") / F.lit(size))


def cell_y(size: float = DEFAULT_CELL) -> Column:
    return F.floor(F.col("latitude") / F.lit(size))


def cell_key(gx: str | Column = "gx", gy: str | Column = "gy") -> Column:
    gx = F.col(gx) if isinstance(gx, str) else gx
    gy = F.col(gy) if isinstance(gy, str) else gy
    return F.concat(F.lit("GRID_"), gx.cast("string"), F.lit("_"), gy.cast("string"))


def offsets(radius: int, with_centre: bool) -> Column:
    """Array of (dx, dy) for the square of the given radius; a constant of the plan."""
    span = range(-radius, radius + 1)
    return F.array(
        *[
            F.struct(F.lit(dx).cast("bigint").alias("dx"), F.lit(dy).cast("bigint").alias("dy"))
            for dx in span
            for dy in span
            if with_centre or (dx, dy) != (0, 0)
        ]
    )
