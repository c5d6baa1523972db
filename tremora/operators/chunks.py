"""Cutting hot keys into time pieces.

An ordered operator (a lag, a running sum, a fold) wants all rows of a key in one
task. When one key holds a large share of the rows, that task decides the run time.
The helpers here cut such keys into pieces along their order column; the operators
then carry what a piece needs from the pieces before it, so results stay exact.

Keys that are not hot keep the single piece ``WHOLE`` and cost nothing extra.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.session import stored

PIECE = "__piece"
HALO = "__halo"
WHOLE = -1


#: Cut points up to this number travel through the driver; more are kept as a table.
MOST_LOCAL_CUTS = 200_000


@dataclass(frozen=True)
class PiecePlan:
    """How keys are cut. ``cuts`` is None when no key needs cutting."""

    keys: tuple[str, ...]
    order: str
    cuts: DataFrame | None = None  # key columns, __cuts: ascending, one row per key that is cut
    width: int | None = None  # fixed-width pieces for every key instead of cuts
    most: int = 0  # no key has more cuts than this

    @property
    def is_whole(self) -> bool:
        return self.cuts is None and self.width is None

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the piece number of each row; WHOLE for keys that are not cut.

        A piece is the number of its key's cuts up to the row's place in the order, found by
        halving: a few steps even for very many pieces. A row without a place is in piece 0.
        """
        if self.width is not None:
            return df.withColumn(PIECE, F.floor(F.col(self.order) / F.lit(self.width)))
        if self.cuts is None:
            return df.withColumn(PIECE, F.lit(WHOLE).cast("bigint"))
        match = [F.col(key) == F.col(f"__cut_key{i}") for i, key in enumerate(self.keys)]
        steps = [1 << i for i in range(self.most.bit_length() - 1, -1, -1)]
        piece = F.aggregate(
            F.array(*[F.lit(step).cast("int") for step in steps]),
            F.lit(0).cast("int"),
            lambda at, step: at
            + F.when(F.get("__cuts", at + step - 1) <= F.col(self.order), step).otherwise(F.lit(0)),
        )
        piece = F.when(F.col("__cuts").isNull(), F.lit(WHOLE)).otherwise(piece).cast("bigint")
        return df.join(self.cuts, match, "left").select(*df.columns, piece.alias(PIECE))

    def only_cut(self, df: DataFrame) -> DataFrame:
        """Rows (of an assigned frame) that belong to keys that are cut."""
        return df if self.width is not None else df.where(F.col(PIECE) != WHOLE)


def calendar_pieces(keys: Sequence[str], order: str, width: int) -> PiecePlan:
    """Cut every key at multiples of ``width``. Needs no look at the data."""
    return PiecePlan(tuple(keys), order, width=width)


def plan_pieces(
    df: DataFrame, keys: Sequence[str], order: str, target_rows: int = 4_000_000
) -> PiecePlan:
    """Cut every key with more than ``target_rows`` rows at quantiles of ``order``.

    One counting job over the key columns; if it finds no hot key, that is all. Otherwise the
    hot keys' values of ``order`` go through a quantile sketch per key: mergeable, so it is
    filled before the exchange, of bounded size, and with a rank error below half a target.
    Pieces hold at most about twice the target, wherever the rows lie: one clock set to zero, or
    nine tenths of the rows in a moment, move the cuts and not the sizes. Only rows that share
    one value of ``order`` stay together whatever their number.

    No number of keys or pieces is too many: beyond MOST_LOCAL_CUTS the cuts are a stored table,
    which Spark broadcasts where it is small and joins with split partitions otherwise.
    """
    keys = tuple(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    # Names of its own, so that joining it to any frame is unambiguous.
    hot = counts.where(F.col("__n") > target_rows).select(
        *[F.col(key).alias(f"__cut_key{i}") for i, key in enumerate(keys)],
        F.expr(f"(__n + {target_rows - 1}) div {target_rows}").alias("__pieces"),
    )
    found = hot.limit(MOST_LOCAL_CUTS // 64 + 1).toArrow()
    if not found.num_rows:
        return PiecePlan(keys, order)
    if found.num_rows <= MOST_LOCAL_CUTS // 64:
        hot = F.broadcast(df.sparkSession.createDataFrame(found, schema=hot.schema))
        most = max(found.column("__pieces").to_pylist())
        n_cuts = sum(found.column("__pieces").to_pylist())
    else:
        hot = stored(hot, "hot-keys")
        most, n_cuts = hot.agg(F.max("__pieces"), F.sum("__pieces")).first()
    match = [F.col(key) == F.col(f"__cut_key{i}") for i, key in enumerate(keys)]
    names = [c for c in hot.columns if c != "__pieces"]
    # Quantiles for the key with most pieces; others take those nearest to their own.
    ranks = F.split(F.lit(",".join(str(i / most) for i in range(1, most))), ",").cast("array<double>")
    quantiles = (
        df.select(*keys, order)
        .join(hot, match)
        .groupBy(*names, "__pieces")
        .agg(F.percentile_approx(order, ranks, 8 * most).alias("__q"))
    )
    own = F.transform(
        F.sequence(F.lit(1), (F.col("__pieces") - 1).cast("int")),
        lambda i: F.get("__q", F.round(i * F.lit(most) / F.col("__pieces")).cast("int") - 1),
    )
    cuts = quantiles.where("__q IS NOT NULL").select(*names, F.array_distinct(own).alias("__cuts"))
    if n_cuts <= MOST_LOCAL_CUTS:
        cuts = F.broadcast(df.sparkSession.createDataFrame(cuts.toArrow(), schema=cuts.schema))
    else:
        cuts = stored(cuts, "cuts")
    return PiecePlan(keys, order, cuts=cuts, most=int(most))


def over_recent_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    n: int,
    build: Callable[[Window], dict[str, Column]],
    needs: Sequence[str],
    plan: PiecePlan | None = None,
) -> DataFrame:
    """Add columns that look at no more than the ``n`` rows before a row of the same key.

    ``build`` gets the window (partitioned and ordered, without frame) and returns the
    columns; ``needs`` names the columns they read. For cut keys the last ``n`` rows
    before each piece are added to it ahead of its own rows and dropped afterwards. That
    reads the input twice; give it a stored table if it is costly to compute.
    """
    keys, order = list(keys), list(order)
    if plan is None or plan.is_whole:
        return df.withColumns(build(Window.partitionBy(*keys).orderBy(*order)))

    own = plan.assign(df)
    carried_columns = [c for c in dict.fromkeys([*order, *needs]) if c not in keys]
    newest = Window.partitionBy(*keys, PIECE).orderBy(*[F.desc(c) for c in order])
    tails = (
        plan.only_cut(own)
        .select(*keys, PIECE, *carried_columns)
        .withColumn("__rn", F.row_number().over(newest))
        .where(F.col("__rn") <= n)
        .groupBy(*keys, PIECE)
        .agg(F.array_sort(F.collect_list(F.struct(*carried_columns))).alias("__tail"))
    )
    # Every piece in the list has at least one row, so n pieces back are enough.
    before = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(-n, -1)
    halo = (
        tails.withColumn("__rows", F.flatten(F.collect_list("__tail").over(before)))
        .withColumn(
            "__rows",
            F.slice("__rows", F.greatest(F.lit(1), F.size("__rows") - F.lit(n - 1)), F.lit(n)),
        )
        .select(*keys, PIECE, F.explode("__rows").alias("__row"))
        .select(*keys, PIECE, "__row.*", F.lit(True).alias(HALO))
    )
    rows = own.withColumn(HALO, F.lit(False)).unionByName(halo, allowMissingColumns=True)
    window = Window.partitionBy(*keys, PIECE).orderBy(*order)
    return rows.withColumns(build(window)).where(~F.col(HALO)).drop(HALO, PIECE)
