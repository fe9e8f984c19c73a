"""Additive hourly counts and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinderlog.fixed import SEVERITIES

KEYS = ["service_name", "severity", "hour"]


def hourly_counts(logs: DataFrame) -> DataFrame:
    """Events per service, severity and hour; counted per task before the shuffle."""
    return logs.groupBy("service_name", "severity", F.date_trunc("hour", "timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("count")
    ).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def merge_counts(partials: DataFrame) -> DataFrame:
    """Sum additive partial counts by key."""
    return partials.groupBy(*KEYS).agg(F.sum("count").alias("count"))


def severity_facets(counts: DataFrame) -> DataFrame:
    """Count of every severity, zero included, from the rollup."""
    found = counts.groupBy("severity").agg(F.sum("count").alias("n"))
    domain = counts.sparkSession.range(1).select(
        F.posexplode(F.array(*map(F.lit, SEVERITIES))).alias("ordinal", "severity")
    )
    joined = domain.join(found, "severity", "left")
    return joined.select("severity", "ordinal", F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))
