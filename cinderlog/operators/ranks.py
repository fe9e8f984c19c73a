"""Positions and exact ranks without a single-task window.

Rows are range-partitioned by key and order, so a hot key spreads over many
slices. A slice table, one row per slice and key, carries the running totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cinderlog.session import durable

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number below this bit


def range_slices(
    df: DataFrame, keys: list[str], order: list[str], weight: str | None = None, slices: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Sorted rows tagged with ``_slice`` and ``_idx``, and the slice table.

    ``order`` must make rows distinct within a key for results to be repeatable.
    Range bounds come from sampling and could differ between two runs of the
    same plan, so the sorted rows are made durable before they are used twice.
    """
    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [*keys, *order]
    ranged = durable(df.repartitionByRange(slices, *cols).sortWithinPartitions(*cols))
    rows = ranged.withColumns(
        {
            "_slice": F.spark_partition_id(),
            "_idx": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        }
    )
    total = F.sum(weight) if weight else F.count(F.lit(1))
    table = rows.groupBy("_slice", *keys).agg(F.min("_idx").alias("_first"), total.alias("_total"))
    # One row per slice and key: without keys that is one row per partition.
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    return rows, table


def row_numbers(df: DataFrame, name: str, materialize: bool = True) -> DataFrame:
    """Zero-based number of every row in its present order, without a shuffle.

    The rows are read twice, so they are made durable first; a caller whose
    rows are stable (persisted, and made without any exchange) may skip that.
    """
    rows = (durable(df) if materialize else df).withColumns(
        {
            "_slice": F.spark_partition_id(),
            "_idx": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        }
    )
    table = rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("_total"))
    # One row per partition.
    before = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    table = table.select("_slice", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    return rows.join(F.broadcast(table), "_slice").select(*df.columns, (F.col("_offset") + F.col("_idx")).alias(name))


def _join_slices(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        table = F.broadcast(table)  # one row per partition
    return rows.join(table, ["_slice", *keys])


def positions(
    df: DataFrame, keys: list[str], order: list[str], name: str, slices: int | None = None
) -> DataFrame:
    """Zero-based position of every row within its key."""
    rows, table = range_slices(df, keys, order, slices=slices)
    placed = _join_slices(rows, table, keys)
    return placed.select(*df.columns, (F.col("_offset") + F.col("_idx") - F.col("_first")).alias(name))


def values_at_ranks(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks: dict[str, Column],
    totals_of: dict[str, tuple[Column, str]] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Exact order statistics: per key the value at each zero-based rank.

    ``ranks`` maps an output name to an expression over ``n``, the number of
    values of the key. Equal values are counted before the shuffle; after the
    slice table says which slice holds a rank, only that slice is ranked.

    ``totals_of`` adds plain aggregates from the same pass over the input: a
    name, an aggregate per (key, value) and how those merge (sum, min or max).
    Null values have no rank but do count there.
    """
    if not keys:
        one = df.withColumn("_all", F.lit(1))
        return values_at_ranks(one, ["_all"], value, ranks, totals_of, slices).drop("_all")
    totals_of = totals_of or {}
    counts = df.groupBy(*keys, value).agg(
        F.count(value).alias("_n"), *[agg.alias(name) for name, (agg, _) in totals_of.items()]
    )
    rows, table = range_slices(counts, keys, [value], weight="_n", slices=slices)
    totals = table.groupBy(*keys).agg(F.sum("_total").alias("n"))
    wanted = totals.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("_label"), e.cast("bigint").alias("_rank")) for k, e in ranks.items()])
        ).alias("_w"),
    ).select(*keys, "_w.*")
    holder = table.join(wanted, keys).where(
        (F.col("_rank") >= F.col("_offset")) & (F.col("_rank") < F.col("_offset") + F.col("_total"))
    )
    near = rows.join(holder.select("_slice", *keys, "_label", "_rank", "_offset"), ["_slice", *keys])
    upto = Window.partitionBy(*keys, "_label").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_end", F.col("_offset") + F.sum("_n").over(upto))
    picked = near.where(F.col("_end") > F.col("_rank"))
    found = picked.groupBy(*keys).agg(*[F.min(F.when(F.col("_label") == k, F.col(value))).alias(k) for k in ranks])
    if not totals_of:
        return found
    merged = rows.groupBy(*keys).agg(*[getattr(F, how)(name).alias(name) for name, (_, how) in totals_of.items()])
    return merged.join(found, keys, "left")


def nearest_rank(percent: int) -> Column:
    """Rank ``floor(n * percent / 100)`` of ``n`` sorted values, counted from zero."""
    return F.expr(f"n * {int(percent)} div 100")
