"""Rates, debounced thresholds and scaling recommendations over a metrics table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.operators.chunks import PiecePlan, over_recent_rows

WEEK_DAYS = 7


@dataclass(frozen=True)
class Policy:
    """Bounds of the scaling rules; the loads are fractions, the duration is in seconds."""

    rate_high: float
    rate_low: float
    cpu_high: float
    cpu_low: float
    duration: int
    min_samples: int = 3
    parallelism_min: int = 3
    parallelism_max: int = 12
    workers_min: int = 3
    workers_max: int = 6


# The two published sets of bounds.
PRODUCTION = Policy(rate_high=3000, rate_low=800, cpu_high=0.8, cpu_low=0.5, duration=50)
DOCUMENTED = Policy(rate_high=1000, rate_low=200, cpu_high=0.8, cpu_low=0.3, duration=30)


def counter_rate(
    samples: DataFrame,
    by: str = "job_id",
    order: tuple[str, ...] = ("ts",),
    plan: PiecePlan | None = None,
) -> DataFrame:
    """Turn a growing counter into whole records per second since the sample before.

    0 on the first sample, when no time has passed, and when the counter went back.
    Give ``order`` a tie-breaker if samples of a job can share a second.
    """

    def columns(window: Window) -> dict[str, Column]:
        return {
            "__d_total": F.col("total_records") - F.lag("total_records").over(window),
            "__d_ts": F.col("ts") - F.lag("ts").over(window),
        }

    needs = ["total_records", "ts"]
    return (
        over_recent_rows(samples, [by], order, 1, columns, needs, plan)
        .withColumn(
            "rate",
            F.when(
                (F.col("__d_ts") > 0) & (F.col("__d_total") >= 0),
                F.expr("__d_total div __d_ts"),
            ).otherwise(F.lit(0).cast("bigint")),
        )
        .drop("__d_total", "__d_ts")
    )


def mean_load(loads: DataFrame, by: str = "ts") -> DataFrame:
    """Mean load over nodes per sampling time, cut (not rounded) to four decimals.

    A node that answered without a load counts as one with load 0, so a sample of such nodes
    only has the mean 0.0. Computed in decimals: a binary mean of 0.12 and 0.13 may fall just
    below 0.125.
    """
    exact = F.coalesce(F.col("cpu").cast("decimal(22,12)"), F.lit(0).cast("decimal(22,12)"))
    return (
        loads.groupBy(by)
        .agg(F.sum(exact).alias("__sum"), F.count(F.lit(1)).alias("nodes"))
        .withColumn(
            "cpu",
            F.expr("cast(__sum * 10000 as decimal(38,12)) div nodes") / F.lit(10000.0),
        )
        .drop("__sum")
    )


def retain(metrics: DataFrame, now: int, days: int = WEEK_DAYS) -> DataFrame:
    """Samples of the last ``days`` days; the bound itself is kept."""
    return metrics.where(F.col("ts") >= now - days * 86_400)


def sustained(
    metrics: DataFrame,
    conditions: dict[str, Column],
    duration: int,
    min_samples: int = 3,
    by: str = "job_id",
    slice_seconds: int = 86_400,
) -> DataFrame:
    """Add one flag per condition: it held on all samples of the last ``duration`` seconds.

    Both ends of the span count, and at least ``min_samples`` samples must lie in it.
    A job's samples are worked on in slices of time, each slice with the ``duration``
    seconds before it, so a job that wrote most of the samples is no single task.
    A sample without a time is in no span: all its flags are false.
    """
    width = max(slice_seconds, duration + 1)
    # Samples without a time meet nobody; numbers below all slices spread them over tasks.
    apart = F.lit(-(1 << 60)) + F.monotonically_increasing_id() % 4096
    until = F.coalesce(F.floor((F.col("ts") + F.lit(duration)) / F.lit(width)), F.col("__own"))
    job = Window.partitionBy(by, "__slice").orderBy("ts")
    so_far = job.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    since = F.col("ts") - F.lit(duration)

    # Looking back over the span for every sample would cost its length each time. "All
    # samples in the span hold" is the same as "the last that does not lies before it",
    # and "at least n" as "the n-th last lies in it"; both are running maxima.
    def last_breach(condition: Column) -> Column:
        return F.max(F.when(~F.coalesce(condition, F.lit(False)), F.col("ts"))).over(so_far)

    breaches = {f"__breach_{name}": last_breach(c) for name, c in conditions.items()}
    sliced = (
        metrics.withColumn("__own", F.coalesce(F.floor(F.col("ts") / F.lit(width)), apart))
        .withColumn("__slice", F.explode(F.sequence("__own", until)))
        .withColumns({"__nth": F.lag("ts", min_samples - 1).over(job), **breaches})
        .withColumn("__nth", F.max("__nth").over(so_far))
    )
    enough = F.coalesce(F.col("__nth") >= since, F.lit(False))
    held = {
        name: enough & F.coalesce(F.col(f"__breach_{name}") < since, F.lit(True))
        for name in conditions
    }
    return (
        sliced.withColumns(held)
        .where(F.col("__slice") == F.col("__own"))
        .drop("__slice", "__own", "__nth", *breaches)
    )


def policy_conditions(policy: Policy) -> dict[str, Column]:
    """What a sample must meet for each of a policy's four rules."""
    rate, cpu = F.col("throughput"), F.col("cpu")
    return {
        "rate_high": rate > policy.rate_high,
        "rate_low": rate < policy.rate_low,
        "cpu_high": cpu > policy.cpu_high,
        "cpu_low": cpu < policy.cpu_low,
    }


def recommend(metrics: DataFrame, policy: Policy = PRODUCTION, **slicing: int) -> DataFrame:
    """One recommendation per sample; the first rule that matches wins."""
    conditions = policy_conditions(policy)
    return decide(sustained(metrics, conditions, policy.duration, policy.min_samples, **slicing), policy)


def decide(flagged: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The recommendation that follows from a sample's debounced flags.

    A rate rule that is already at its bound falls through to the next rule. A worker
    rule at its bound matches and asks for nothing.
    """
    p = policy
    parallelism, workers = F.col("parallelism"), F.col("worker_count")
    rules = [
        ("rate_high", parallelism < p.parallelism_max),
        ("rate_low", parallelism > p.parallelism_min),
        ("cpu_high", F.lit(True)),
        ("cpu_low", F.lit(True)),
    ]
    matched = F.coalesce(*[F.when(F.col(name) & can, F.lit(name)) for name, can in rules])
    rule = F.col("rule")
    return flagged.withColumn("rule", F.coalesce(matched, F.lit("none"))).withColumns(
        {
            "action": F.when(rule == "rate_high", "parallelism_up")
            .when(rule == "rate_low", "parallelism_down")
            .when((rule == "cpu_high") & (workers < p.workers_max), "worker_up")
            .when((rule == "cpu_low") & (workers > p.workers_min), "worker_down")
            .otherwise("none"),
            "target_parallelism": F.when(
                rule == "rate_high", F.least(parallelism + 2, F.lit(p.parallelism_max))
            )
            .when(rule == "rate_low", F.greatest(parallelism - 1, F.lit(p.parallelism_min)))
            .otherwise(parallelism),
            "target_workers": F.when(
                (rule == "cpu_high") & (workers < p.workers_max), workers + 1
            )
            .when((rule == "cpu_low") & (workers > p.workers_min), workers - 1)
            .otherwise(workers),
        }
    )


def alerts(recommendations: DataFrame) -> DataFrame:
    """A text line for every recommendation that asks for a change."""
    when = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm:ss")
    text = F.concat_ws(
        " ",
        when,
        F.lit("- ALERT:"),
        F.col("job_id"),
        F.col("action"),
        F.concat(F.lit("parallelism="), F.col("target_parallelism").cast("string")),
        F.concat(F.lit("workers="), F.col("target_workers").cast("string")),
    )
    return recommendations.where(F.col("action") != "none").withColumn("alert", text)
