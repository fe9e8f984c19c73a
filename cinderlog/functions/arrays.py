"""Unnesting arrays without a second evaluation of what they are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def unnest(df: DataFrame, array: Column, index: str, value: str, keep: list[str]) -> DataFrame:
    """One row per element with its index; rows with an empty or null array vanish.

    A plain explode makes the optimizer add a size filter and push it below all
    projections, where it computes the array anew, a JSON parse included. The
    outer form adds no such filter and its empty rows are dropped afterwards.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(index, value))
    return rows.where(F.col(index).isNotNull())
