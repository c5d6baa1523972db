"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

DOC_KEY = "__doc"
#: Arrow batches on their way to Python: rows differ in size by orders of magnitude.
BATCH_ROWS, BATCH_BYTES = "1000", "8m"


def row_key(*columns: str) -> Column:
    """64-bit identity of a row by its content; nulls count as a value of their own.

    Rows equal in these columns have the same key and therefore the same result.
    """
    parts = []
    for c in columns:
        parts += [F.col(c), F.col(c).isNull()]
    return F.xxhash64(*parts)


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    place = lambda s: (s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *place(s))), ",")


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` marked for broadcasting if it is proven to have at most ``most_rows`` rows.

    The count stops at the bound. A larger frame is returned as it is, so that joins shuffle.
    """
    fits = df.limit(most_rows + 1).count() <= most_rows
    return F.broadcast(df) if fits else df


def bounded_batches(df: DataFrame) -> None:
    """Bound the Arrow batches of this session by rows and by bytes, for workers' memory."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def append_columns(
    df: DataFrame,
    compute: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]],
    fields: Sequence[T.StructField],
    drop: Sequence[str] = (),
) -> DataFrame:
    """Add columns made from Arrow batches; a column of the same name is replaced.

    ``drop`` names columns that only the function needs.

    ``compute`` is called once per task and returns the function for its batches.
    """
    bounded_batches(df)
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names and f.name not in drop]
    schema = T.StructType([*kept, *fields])
    keep = [f.name for f in kept]
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = compute()
        for batch in batches:
            if not batch.num_rows:
                continue
            made = work(batch)
            columns = [batch.column(n) for n in keep] + [made[f.name] for f in fields]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow)],
                names=[f.name for f in schema.fields],
            )

    return df.mapInArrow(run, schema)


def text_batches(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of about ``most_bytes`` each; one text is never cut."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield start, stop
        start = stop
