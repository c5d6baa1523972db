"""Each finished window against the windows before it, on a stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tremora.streaming.stateful import stateful


class WindowHistory(StatefulProcessor):
    """A ring of the last ``n`` windows of a sensor; see operators.history.with_history."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "start bigint, mean double, top float")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("window_start_ts", kind="stable")
        ring = deque(self.ring.get(), maxlen=self.n)
        means, tops = [], []
        columns = ("window_start_ts", "avg_amplitude", "max_amplitude")
        for start, mean, top in zip(*(frame[c].tolist() for c in columns)):
            known = [w[1] for w in ring if w[1] is not None]
            means.append(sum(known) / len(known) if known else None)
            tops.append(max((w[2] for w in ring if w[2] is not None), default=0.0))
            ring.append((start, mean, top))
        self.ring.put(list(ring))
        average = np.array(means, float)
        mean = frame["avg_amplitude"].to_numpy(float)
        with np.errstate(invalid="ignore", divide="ignore"):
            deviation = np.where(average > 0, (mean - average) / average, 0.0)
        frame["history_avg"] = pd.array(means, "Float64")
        frame["history_max"] = np.array(tops, "float32")
        frame["deviation"] = deviation
        yield frame

    def close(self) -> None:
        pass


def with_history_stream(aggregates: DataFrame, n: int = 10) -> DataFrame:
    """Stream form of with_history over the output of window_agg_stream, in the same query.

    In append mode a window comes once, when the watermark has passed it, and the windows of a
    sensor come in order; within a micro-batch they are put in order. The state is ``n``
    windows per sensor.
    """
    schema = T.StructType(
        [
            *aggregates.schema.fields,
            T.StructField("history_avg", T.DoubleType()),
            T.StructField("history_max", T.FloatType()),
            T.StructField("deviation", T.DoubleType()),
        ]
    )
    return stateful(aggregates, ["sensor_id"], WindowHistory(n), schema)
