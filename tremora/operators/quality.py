"""Validity filter, reject reports and the critical flag."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.functions.readings import CRITICAL_AMPLITUDE, validity_rules, violated


def filter_valid(readings: DataFrame) -> DataFrame:
    """Keep readings that meet every rule. Conjuncts stay separate for pushdown."""
    return reduce(lambda df, rule: df.where(rule), validity_rules().values(), readings)


def with_failed_rules(readings: DataFrame) -> DataFrame:
    """Add ``failed_rules``, the names of the violated rules (empty when valid)."""
    names = [F.when(violated(rule), F.lit(name)) for name, rule in validity_rules().items()]
    return readings.withColumn("failed_rules", F.array_compact(F.array(*names)))


def reject_report(readings: DataFrame) -> DataFrame:
    """The rejected readings and why."""
    return (
        with_failed_rules(readings)
        .where(F.size("failed_rules") > 0)
        .select("event_id", "sensor_id", "data_quality", "seismic_amplitude", "failed_rules")
    )


def reject_counts(readings: DataFrame) -> DataFrame:
    """One row: readings seen, readings rejected and violations per rule (rules overlap)."""
    rules = validity_rules()
    any_violated = reduce(lambda a, b: a | b, [violated(r) for r in rules.values()])
    return readings.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(any_violated).alias("rejected"),
        *[F.count_if(violated(rule)).alias(f"bad_{name}") for name, rule in rules.items()],
    )


def with_critical(readings: DataFrame, threshold: float = CRITICAL_AMPLITUDE) -> DataFrame:
    return readings.withColumn("is_critical", F.col("seismic_amplitude") > threshold)


def stage_counts(readings: DataFrame, flagged: DataFrame) -> DataFrame:
    """Readings read, valid and kept, one row per stage.

    ``flagged`` are the valid readings with is_duplicate (see operators.dedup). The readings
    themselves are only counted, which reads no column of them.
    """
    read = readings.agg(F.count(F.lit(1)).alias("read")).selectExpr("'read' AS stage", "read AS records")
    passed = flagged.agg(F.count(F.lit(1)).alias("valid"), F.count_if(~F.col("is_duplicate")).alias("kept"))
    return read.unionByName(passed.selectExpr("stack(2, 'valid', valid, 'kept', kept) AS (stage, records)"))
