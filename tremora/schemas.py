"""Record types. All readers take these explicitly; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

SENSOR_FIELDS = [
    T.StructField("sensor_id", T.StringType()),
    T.StructField("collect_timestamp", T.LongType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("seismic_amplitude", T.FloatType()),
    T.StructField("frequency", T.IntegerType()),
    T.StructField("phase_type", T.StringType()),
    T.StructField("data_quality", T.IntegerType()),
    T.StructField("network_status", T.IntegerType()),
]

# One reading; event_id breaks ties between readings of the same millisecond.
READING = T.StructType([T.StructField("event_id", T.LongType()), *SENSOR_FIELDS])

# A reading as it arrives: encoded bytes under a message id.
PAYLOAD = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("payload", T.BinaryType())]
)

# One row per sensor and window. Counts are BIGINT and the mean is DOUBLE.
AGGREGATE = T.StructType(
    [
        T.StructField("sensor_id", T.StringType()),
        T.StructField("window_start_ts", T.LongType()),
        T.StructField("window_end_ts", T.LongType()),
        T.StructField("avg_amplitude", T.DoubleType()),
        T.StructField("max_amplitude", T.FloatType()),
        T.StructField("min_amplitude", T.FloatType()),
        T.StructField("p_phase_count", T.LongType()),
        T.StructField("s_phase_count", T.LongType()),
        T.StructField("n_phase_count", T.LongType()),
        T.StructField("total_count", T.LongType()),
    ]
)

# Job metrics sampled over time.
METRIC_SAMPLE = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("throughput", T.LongType()),
        T.StructField("cpu", T.DoubleType()),
    ]
)

# Order of a sensor's readings everywhere in this package.
READING_ORDER = ("collect_timestamp", "event_id")
