"""Metrics logs: lines of ``epoch,throughput:x,cpu:y``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = r"^(\d+),throughput:([^,]*),cpu:([^,]*)$"


def parse_metrics(lines: DataFrame, job_id: str | Column, column: str = "value") -> DataFrame:
    """Lines of another shape are left out (see odd_lines); a value that is no number is 0,
    a time beyond 64 bits NULL."""

    def part(i: int):
        return F.regexp_extract(column, LINE, i)

    return lines.where(F.col(column).rlike(LINE)).select(
        (job_id if isinstance(job_id, Column) else F.lit(job_id)).alias("job_id"),
        part(1).try_cast("bigint").alias("ts"),
        F.coalesce(part(2).try_cast("bigint"), F.lit(0).cast("bigint")).alias("throughput"),
        F.coalesce(part(3).try_cast("double"), F.lit(0.0)).alias("cpu"),
    )


def odd_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines that parse_metrics leaves out, empty and NULL ones included."""
    return lines.where(~F.coalesce(F.col(column).rlike(LINE), F.lit(False)))


def read_metrics_log(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    return parse_metrics(spark.read.text(path), job_id)


def read_job_logs(spark: SparkSession, path: str) -> DataFrame:
    """Logs of many jobs, each in its own folder ``job_id=...``."""
    lines = spark.read.schema("value string, job_id string").text(path)
    return parse_metrics(lines, F.col("job_id"))


def log_line() -> Column:
    return F.concat_ws(
        ",",
        F.col("ts").cast("string"),
        F.concat(F.lit("throughput:"), F.col("throughput").cast("string")),
        F.concat(F.lit("cpu:"), F.format_string("%.4f", F.col("cpu"))),
    )


def format_metrics(metrics: DataFrame) -> DataFrame:
    """The log lines of a metrics table, one column ``value``; the inverse of parse_metrics."""
    return metrics.select(log_line().alias("value"))
