"""Hot and cold keys of an access log (any frame with a key and a millisecond time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kth_access(
    log: DataFrame, k: int = 2, key: str = "sensor_id", ts: str = "collect_timestamp"
) -> DataFrame:
    """Time of the k-th most recent access per key; 0 for keys with fewer accesses.

    The rank filter is applied in each task before the exchange as well (Spark's window
    group limit), so a key with a third of the rows sends k rows per task.
    """
    newest = Window.partitionBy(key).orderBy(F.desc(ts))
    recent = (
        log.select(key, ts)
        .withColumn("__rn", F.row_number().over(newest))
        .where(F.col("__rn") <= k)
    )
    return recent.groupBy(key).agg(
        F.coalesce(F.max(F.when(F.col("__rn") == k, F.col(ts))), F.lit(0)).alias("kth_access")
    )


def access_frequency(
    log: DataFrame, as_of: int, key: str = "sensor_id", ts: str = "collect_timestamp"
) -> DataFrame:
    """Accesses per second since the first one; the plain count if no time has passed."""
    age = F.lit(as_of) - F.col("first_access")
    return (
        log.groupBy(key)
        .agg(F.count(F.lit(1)).alias("access_count"), F.min(ts).alias("first_access"))
        .withColumn(
            "frequency",
            F.when(age <= 0, F.col("access_count").cast("double")).otherwise(
                F.col("access_count") * F.lit(1000.0) / age
            ),
        )
    )


def decayed_frequency(
    log: DataFrame,
    as_of: int,
    decay: float = 0.95,
    key: str = "sensor_id",
    ts: str = "collect_timestamp",
) -> DataFrame:
    """Access count times decay to the power of the seconds since the last access."""
    idle_seconds = (F.lit(as_of) - F.col("last_access")) / F.lit(1000.0)
    return (
        log.groupBy(key)
        .agg(F.count(F.lit(1)).alias("access_count"), F.max(ts).alias("last_access"))
        .withColumn("decayed_frequency", F.col("access_count") * F.pow(F.lit(decay), idle_seconds))
    )


def coldest(log: DataFrame, k: int = 2, n: int = 100, key: str = "sensor_id", **kw) -> DataFrame:
    """The ``n`` keys whose k-th access lies furthest back."""
    return kth_access(log, k, key, **kw).orderBy("kth_access", key).limit(n)


def hottest(log: DataFrame, k: int = 2, n: int = 100, key: str = "sensor_id", **kw) -> DataFrame:
    """The ``n`` keys with the most recent k-th access."""
    return kth_access(log, k, key, **kw).orderBy(F.desc("kth_access"), key).limit(n)


def active_sensors(
    readings: DataFrame,
    as_of: int,
    ttl_ms: int = 60_000,
    key: str = "sensor_id",
    ts: str = "collect_timestamp",
) -> DataFrame:
    """Keys whose last reading is no older than ``ttl_ms`` at ``as_of``."""
    return (
        readings.where(F.col(ts) <= as_of)
        .groupBy(key)
        .agg(F.max(ts).alias("last_seen"))
        .where(F.lit(as_of) - F.col("last_seen") <= ttl_ms)
    )
