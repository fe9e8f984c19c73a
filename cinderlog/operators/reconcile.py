"""Compare what was sent with what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def compare_events(expected: DataFrame, stored: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per key: copies on either side and whether the stored fields agree.

    Both sides go through one aggregation over their union: copies collapse
    before the shuffle and no join has to match repeated keys.
    """
    # The hash skips NULLs, so which fields are NULL is part of it.
    fingerprint = F.xxhash64(*fields, *[F.col(f).isNull() for f in fields])
    sides = expected.select(*keys, F.lit(1).alias("_e"), F.lit(0).alias("_s"), fingerprint.alias("_h")).unionByName(
        stored.select(*keys, F.lit(0).alias("_e"), F.lit(1).alias("_s"), fingerprint.alias("_h"))
    )
    from_e, from_s = F.when(F.col("_e") == 1, F.col("_h")), F.when(F.col("_s") == 1, F.col("_h"))
    grouped = sides.groupBy(*keys).agg(
        F.sum("_e").alias("expected"),
        F.sum("_s").alias("stored"),
        F.min(from_e).alias("_want"),
        F.min(from_s).alias("_low"),
        F.max(from_s).alias("_high"),
    )
    same = (F.col("_low") == F.col("_want")) & (F.col("_high") == F.col("_want"))
    return grouped.select(
        *keys,
        "expected",
        "stored",
        F.when((F.col("expected") > 0) & (F.col("stored") > 0), ~same).otherwise(F.lit(False)).alias("altered"),
    )


def reconcile(compared: DataFrame, by: list[str]) -> DataFrame:
    """Totals per marker: lost, repeated, unexpected and altered events."""
    e, s = F.col("expected"), F.col("stored")
    return compared.groupBy(*by).agg(
        F.sum("expected").alias("expected"),
        F.sum("stored").alias("stored"),
        F.count_if((e > 0) & (s == 0)).alias("missing"),
        F.count_if(s > 1).alias("duplicated"),
        F.count_if((e == 0) & (s > 0)).alias("unexpected"),
        F.count_if("altered").alias("altered"),
    ).withColumn(
        "passed",
        (F.col("missing") == 0) & (F.col("duplicated") == 0) & (F.col("unexpected") == 0) & (F.col("altered") == 0),
    )
