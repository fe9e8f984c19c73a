"""Idempotent event handling."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F


def dedup(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``; a row with a NULL in its key has no key and stays.

    ``min_by`` keeps one candidate per key and task before the shuffle, so any
    number of copies of one event reaches the reducer as a few rows.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    known = reduce(and_, (F.col(k).isNotNull() for k in keys))
    picked = df.where(known).groupBy(*keys).agg(best)
    named = picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
    return named.unionByName(df.where(~known))
