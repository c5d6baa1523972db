"""Row-multiset comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from collections import Counter


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(canonical(r[i]) for i in order) for r in records]


def assert_same(spark_df, duck_relation):
    assert sorted(spark_df.columns) == sorted(duck_relation.columns)
    ours = Counter(rows(spark_df.columns, [tuple(r) for r in spark_df.collect()]))
    theirs = Counter(rows(duck_relation.columns, duck_relation.fetchall()))
    missing, extra = theirs - ours, ours - theirs
    assert not missing and not extra, (
        f"{sum(missing.values())} missing, {sum(extra.values())} extra of {sum(theirs.values())}: "
        f"{list(missing)[:3]} / {list(extra)[:3]}"
    )
