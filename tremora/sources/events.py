"""Views that give the generic event table the shape of this package's inputs.

Used by the registered queries, the tests and the bench. Values are spread so that every
validity rule rejects something, phases include an unknown one and amplitudes go negative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READING_EXPRS = [
    "event_id",
    """concat(CASE WHEN user_id % 29 = 0 THEN 'probe_' ELSE 'sensor_' END,
              lpad(CAST(user_id AS STRING), 4, '0'), '_region_', CAST(user_id % 5 AS STRING))
       AS sensor_id""",
    "unix_millis(CAST(ts AS TIMESTAMP)) AS collect_timestamp",
    """CASE WHEN event_id % 97 = 0 THEN 140.0D ELSE 108.0D + user_id * 0.001D END
       AS longitude""",
    """CASE WHEN event_id % 89 = 0 THEN 60.0D ELSE 34.0D + user_id * 0.001D END
       AS latitude""",
    "CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 50 ELSE 100 END AS depth",
    """CAST(CASE WHEN event_id % 7 = 0 THEN -value ELSE value END AS FLOAT)
       AS seismic_amplitude""",
    "10 AS frequency",
    """CASE event_type WHEN 'click' THEN 'P' WHEN 'view' THEN 'S'
                       WHEN 'signup' THEN 'X' ELSE 'N' END AS phase_type""",
    "CASE WHEN event_id % 20 = 3 THEN 0 ELSE 1 END AS data_quality",
    "5 AS network_status",
]


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def time_slices(df: DataFrame, order: str, slices: int) -> list[DataFrame]:
    """Consecutive parts of about equal size; the bounds are approximate quantiles.

    Rows without a value of ``order`` come with the first part.
    """
    inner = df.approxQuantile(order, [i / slices for i in range(1, slices)], 0.01)
    edges = [float("-inf"), *sorted(set(inner)), float("inf")]
    at = F.col(order)
    parts = [(at >= lo) & (at < hi) for lo, hi in zip(edges, edges[1:])]
    return [df.where(part if i else part | at.isNull()) for i, part in enumerate(parts)]


def as_readings(events: DataFrame) -> DataFrame:
    return events.selectExpr(*READING_EXPRS)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_readings(read_events(spark, sf_dir))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded readings; every fiftieth is junk bytes."""
    from tremora.sources.payloads import encode_payloads

    junk = F.expr("event_id % 50 = 0")
    return encode_payloads(readings(spark, sf_dir)).withColumn(
        "payload", F.when(junk, F.unhex(F.lit("ffff"))).otherwise(F.col("payload"))
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job metrics: load levels change every 8 or 12 hours, noise within a level."""
    return (
        read_events(spark, sf_dir)
        .withColumn("ts", F.expr("unix_millis(CAST(ts AS TIMESTAMP)) div 1000"))
        .selectExpr(
            "event_id AS sample_id",
            "concat('job_', CAST(user_id % 16 AS STRING)) AS job_id",
            "ts",
            "((ts div 43200) % 4) * 1200 + CAST(floor(value) AS BIGINT) AS throughput",
            "((ts div 28800) % 5) * 0.21D + (event_id % 100) / 10000D AS cpu",
            "CAST(3 + ts div 86400 % 10 AS INT) AS parallelism",
            "CAST(3 + ts div 86400 % 4 AS INT) AS worker_count",
        )
    )


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A growing record counter per job that starts again now and then."""
    return (
        read_events(spark, sf_dir)
        .withColumn("ts", F.expr("unix_millis(CAST(ts AS TIMESTAMP)) div 1000"))
        .selectExpr(
            "event_id AS sample_id",
            "concat('job_', CAST(user_id % 16 AS STRING)) AS job_id",
            "ts",
            "CASE WHEN event_id % 50 = 7 THEN 0 ELSE event_id * 100000 END AS total_records",
        )
    )


def node_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CPU load per node, sampled hourly; at times no node tells its load."""
    return (
        read_events(spark, sf_dir)
        .withColumn("ts", F.expr("unix_millis(CAST(ts AS TIMESTAMP)) div 3600000 * 3600"))
        .selectExpr(
            "ts",
            "user_id % 3 AS node_id",
            "CASE WHEN event_id % 41 = 0 OR event_id % 720 < 60 THEN NULL ELSE value / 1000 END AS cpu",
        )
    )
