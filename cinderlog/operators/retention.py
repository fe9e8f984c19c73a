"""Retention: which day partitions go, and removing them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cinderlog.fixed import LOG_RETENTION_DAYS


def by_partition_start(
    logs: DataFrame, as_of: Column, days: int = LOG_RETENTION_DAYS, day: str = "event_date"
) -> DataFrame:
    """Days whose start lies before the cutoff.

    The boundary day goes as a whole although its later rows are younger than
    the cutoff.
    """
    cutoff = as_of - F.make_dt_interval(F.lit(days))
    return logs.groupBy(F.col(day).alias("event_date")).agg(F.count(F.lit(1)).alias("rows")).select(
        "event_date", "rows", (F.col("event_date").cast("timestamp_ntz") < cutoff).alias("dropped")
    )


def by_row_age(
    logs: DataFrame, as_of: Column, days: int = LOG_RETENTION_DAYS, day: str = "event_date", ts: str = "timestamp"
) -> DataFrame:
    """Days in which every row has outlived ``days``; a day goes only as a whole."""
    age = F.make_dt_interval(F.lit(days))
    return logs.groupBy(F.col(day).alias("event_date")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(ts).alias("newest")
    ).select("event_date", "rows", "newest", (F.col("newest") + age < as_of).alias("dropped"))


def delete_paths(spark: SparkSession, paths: list[str]) -> int:
    """Remove table folders through the file system the table lives on."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        removed += bool(target.getFileSystem(conf).delete(target, True))
    return removed


def drop_aged_days(
    spark: SparkSession, path: str, logs: DataFrame, as_of: dt.datetime, days: int = LOG_RETENTION_DAYS, ts: str = "timestamp"
) -> int:
    """Drop the ``event_date=`` folders in which every row has outlived ``days``, return how many.

    ``logs`` are the rows of ``path``; only their times are read, and one row per
    expired day comes to the driver. Folders of loads that aren't committed stay, and so does the
    day then: a load in flight must find its rows when it commits.
    """
    aged = by_row_age(logs, F.lit(as_of).cast("timestamp_ntz"), days, ts=ts).where("dropped")
    return _drop_days(spark, path, [f"{path}/event_date={r['event_date']}" for r in aged.select("event_date").collect()])


def _drop_days(spark: SparkSession, path: str, days: list[str]) -> int:
    """Remove day folders; of a day with loads in flight only the committed ones. Returns how many went whole."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole, parts = [], []
    for day in days:
        loads = [s.getPath() for s in fs.listStatus(at(day)) if s.getPath().getName().startswith("load=")]
        done = [str(p) for p in loads if fs.exists(at(f"{path}/_loads/{p.getName().removeprefix('load=')}"))]
        if len(done) == len(loads):
            whole.append(day)
        else:
            parts += done
    delete_paths(spark, parts)
    # The postings of what goes.
    delete_paths(spark, ["/_terms/event_date=".join(p.rsplit("/event_date=", 1)) for p in whole + parts])
    return delete_paths(spark, whole)


def drop_old_days(
    spark: SparkSession, path: str, as_of: dt.datetime, days: int = LOG_RETENTION_DAYS
) -> int:
    """Drop the expired ``event_date=`` folders of a log table, return how many.

    Only the folder names are listed; no data is read. Loads in flight stay, as in ``drop_aged_days``.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    cutoff = as_of - dt.timedelta(days=days)
    expired = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith("event_date="):
            try:
                start = dt.datetime.fromisoformat(name.split("=", 1)[1])
            except ValueError:
                continue  # not a day folder
            if start < cutoff:
                expired.append(status.getPath().toString())
    return _drop_days(spark, path, expired)
