"""Metric datapoints rolled up to a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinderlog.functions.times import ntz
from cinderlog.operators import ranks


def select_points(
    points: DataFrame, start, end, metric: str | None = None, labels: dict[str, str] | None = None
) -> DataFrame:
    """Datapoints of a time range, optionally of one metric and with given labels."""
    rows = points.where((F.col("timestamp") >= ntz(start)) & (F.col("timestamp") <= ntz(end)))
    if metric is not None:
        rows = rows.where(F.col("metric_name") == metric)
    for key, value in (labels or {}).items():
        rows = rows.where(F.col("labels")[key] == value)
    return rows


def metric_rollup(points: DataFrame, step_seconds: int, slices: int | None = None) -> DataFrame:
    """sum, avg, min, max, p95 and p99 per metric and step.

    Percentiles are exact: the value at rank ``floor(n * p / 100)``.
    """
    start = F.window("timestamp", f"{int(step_seconds)} seconds")["start"].cast("timestamp_ntz")
    keyed = points.select("metric_name", start.alias("window_start"), "value")
    keys = ["metric_name", "window_start"]
    totals = {
        "points": (F.count("value"), "sum"),
        "sum": (F.sum("value"), "sum"),
        "min": (F.min("value"), "min"),
        "max": (F.max("value"), "max"),
    }
    high = {"p95": ranks.nearest_rank(95), "p99": ranks.nearest_rank(99)}
    found = ranks.values_at_ranks(keyed, keys, "value", high, totals, slices)
    return found.withColumn("avg", F.col("sum") / F.col("points"))
