"""Severity ordinals and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cinderlog.fixed import SEVERITIES, SEVERITY_ALIASES, SEVERITY_FALLBACK


def ordinal(severity: Column) -> Column:
    """0 for the lowest level; null for an unknown one."""
    found = F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)
    return F.when(found > 0, (found - 1).cast("int"))


def at_least(severity: Column, minimum: str) -> Column:
    """``severity >= minimum`` as a membership test, which Parquet can push down."""
    if minimum not in SEVERITIES:
        raise ValueError(f"unknown severity {minimum!r}")
    return severity.isin(SEVERITIES[SEVERITIES.index(minimum):])


def is_known(severity: Column) -> Column:
    return F.coalesce(severity.isin(SEVERITIES), F.lit(False))


def normalize(raw: Column) -> Column:
    """Struct of the level read from ``raw`` and whether it was recognised."""
    level = raw
    for alias, target in SEVERITY_ALIASES.items():
        level = F.when(raw == alias, F.lit(target)).otherwise(level)
    known = is_known(level)
    return F.struct(
        F.when(known, level).otherwise(F.lit(SEVERITY_FALLBACK)).alias("severity"),
        known.alias("recognised"),
    )
