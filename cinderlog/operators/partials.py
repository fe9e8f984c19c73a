"""Additive hourly counts as a table: loads of partials, merging by tiers, retention.

A load adds partial counts; a key's count is the sum over its partials, so loads of
one day can be merged in any order. Whenever ``fanout`` visible loads of a day are of
one tier they become one load of the next tier: a reader meets fewer than ``fanout``
loads of each tier, and a partial is rewritten once for each tier.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cinderlog.fixed import ROLLUP_RETENTION_DAYS
from cinderlog.operators import ledger, retention, rollup

PARTIALS_DDL = "service_name string, severity string, hour timestamp_ntz, count bigint, event_date date, load string"
FANOUT = 8
MERGED = "merged-"


def append(counts: DataFrame, path: str, writer: str, batch: int) -> None:
    """Add the partials of one micro-batch; one that was added before changes nothing, also after merging."""
    spark, load = counts.sparkSession, f"{writer}-{batch}"
    if ledger.is_committed(spark, path, load):
        return
    ledger.drop_attempt(spark, path, load)
    _write(counts.withColumns({"event_date": F.to_date("hour"), "load": F.lit(load)}), path)
    ledger.commit(spark, path, load, writer=writer, batch=batch)


def _write(rows: DataFrame, path: str) -> None:
    (
        rows.hint("rebalance", F.col("event_date"))
        .sortWithinPartitions("event_date", "load", *rollup.KEYS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date", "load")
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Partials of the visible loads, with their day and load."""
    return ledger.committed(spark.read.schema(PARTIALS_DDL).parquet(path), ledger.loads(spark, path))


def compact(spark: SparkSession, path: str, fanout: int = FANOUT) -> int:
    """Merge until no day has ``fanout`` loads of one tier; returns how many loads were taken over.

    Appends may go on meanwhile, but only one compaction of a table may run at a time. A merged load
    takes the place of the old ones of its day in one step. Partials of a NULL hour are never merged.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    taken = 0
    while step := _merge_full_tiers(spark, path, fanout):
        taken += step
    return taken


def _merge_full_tiers(spark: SparkSession, path: str, fanout: int) -> int:
    stored = read(spark, path)
    tiers = ledger.loads(spark, path).select("load", F.coalesce("tier", F.lit(0)).alias("tier"))
    # One row per day and load: only partition columns are read, and one row per group comes to the driver.
    folders = stored.where(F.col("event_date").isNotNull()).select("event_date", "load").distinct().join(tiers, "load")
    place = F.row_number().over(Window.partitionBy("event_date", "tier").orderBy("load")) - 1
    groups = (
        folders.withColumn("place", F.floor(place / fanout))
        .groupBy("event_date", "tier", "place")
        .agg(F.array_sort(F.collect_list("load")).alias("old"))
        .where(F.size("old") == fanout)
        .withColumn("target", F.concat(F.lit(MERGED), F.md5(F.concat_ws("/", F.col("event_date").cast("string"), F.col("old")))))
        .collect()
    )
    if not groups:
        return 0
    moves = spark.createDataFrame(
        [(g["event_date"], old, g["target"]) for g in groups for old in g["old"]], "event_date date, load string, target string"
    )
    # Prunes the scan to the days and loads concerned; the join then tells which goes where.
    rows = stored.where(F.col("event_date").isin(sorted({g["event_date"] for g in groups})))
    names = sorted({old for g in groups for old in g["old"]})
    if len(names) <= ledger.FEW_LOADS:
        rows = rows.where(F.col("load").isin(names))
    merged = (
        rows.join(moves, ["event_date", "load"])
        .groupBy(*rollup.KEYS, "event_date", "target")
        .agg(F.sum("count").alias("count"))
        .withColumnRenamed("target", "load")
    )
    _write(merged, path)
    for g in groups:
        ledger.commit(spark, path, g["target"], str(g["event_date"]), g["old"], tier=g["tier"] + 1)
    return len(groups) * fanout


def expire(spark: SparkSession, path: str, as_of: dt.datetime, days: int = ROLLUP_RETENTION_DAYS) -> int:
    """Remove the days whose every hour has outlived ``days``; returns how many. Loads in flight stay."""
    return retention.drop_aged_days(spark, path, read(spark, path), as_of, days, ts="hour")


def sweep(spark: SparkSession, path: str) -> int:
    """Remove folders that merging replaced or a broken compaction left, and ledger files no one needs; returns how many folders.

    Run it between compactions, late enough for readers that began before the last one.
    The last micro-batch of every writer keeps its ledger file, because a stream
    runs no earlier one again; the others' go once none of their folders are left.
    """
    fs, at = ledger.files(spark, path)
    finished = ledger.loads(spark, path).collect()
    known = {r["load"] for r in finished}
    gone = {(f"event_date={r['day']}", old) for r in finished if r["day"] for old in r["replaces"]}
    left, removed = set(), 0
    for status in fs.globStatus(at(f"{path}/event_date=*/load=*")) or []:
        home = status.getPath()
        load = home.getName().removeprefix("load=")
        if (home.getParent().getName(), load) in gone or (load.startswith(MERGED) and load not in known):
            if not fs.delete(home, True) and fs.exists(home):
                raise OSError(f"could not remove {home}")
            removed += 1
        else:
            left.add(load)
    last: dict[str, int] = {}
    for r in finished:
        if r["writer"] is not None:
            last[r["writer"]] = max(last.get(r["writer"], -1), r["batch"])
    for r in finished:
        passed = r["writer"] is not None and r["batch"] < last[r["writer"]]
        if r["load"] not in left and (r["day"] is not None or passed):
            fs.delete(at(f"{path}/_loads/{r['load']}"), False)
    return removed
