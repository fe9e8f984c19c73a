"""Which loads of a table count: ``<path>/_loads/<load>``, one small JSON file for each finished load.

Rows lie in ``<path>/event_date=.../load=...``. A load's rows are visible once its
file is there, all days at once. A merged load names its day and the loads whose
rows of that day it took over.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Loads that a reader spells out in its plan; with more it joins the ledger.
FEW_LOADS = 10_000
LEDGER_DDL = "load string, day date, replaces array<string>, terms string, tier int, writer string, batch bigint"


def files(spark: SparkSession, path: str):
    """The file system of ``path`` and a constructor of its paths."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def make_once(fs, path) -> bool:
    """Create an empty file unless it exists; True for the one who did."""
    try:
        return bool(fs.createNewFile(path))
    except Exception:
        if fs.exists(path):
            return False
        raise


def is_committed(spark: SparkSession, path: str, load: str) -> bool:
    fs, at = files(spark, path)
    return fs.exists(at(f"{path}/_loads/{load}"))


def commit(
    spark: SparkSession, path: str, load: str, day: str | None = None, replaces: list[str] | None = None, **facts
) -> None:
    """Make a load visible: its file appears by one rename.

    ``facts`` are the other columns of the ledger: the text configuration of the
    load's index, the tier of a merged load, the stream and micro-batch it came from.
    """
    fs, at = files(spark, path)
    draft = at(f"{path}/_loads/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps({"load": load, "day": day, "replaces": replaces or [], **facts}).encode()))
    out.close()
    if not fs.rename(draft, at(f"{path}/_loads/{load}")):
        raise OSError(f"could not commit load {load} of {path}")


def drop_attempt(spark: SparkSession, path: str, load: str) -> None:
    """Remove what a try that was never committed left behind: it may have had rows of other days."""
    fs, at = files(spark, path)
    for home in (path, f"{path}/_terms"):
        for status in fs.globStatus(at(f"{home}/event_date=*/load={load}")) or []:
            fs.delete(status.getPath(), True)


def loads(spark: SparkSession, path: str) -> DataFrame:
    """The finished loads, ``LEDGER_DDL``."""
    fs, at = files(spark, path)
    fs.mkdirs(at(f"{path}/_loads"))
    return spark.read.schema(LEDGER_DDL).json(f"{path}/_loads")


def committed(rows: DataFrame, finished: DataFrame) -> DataFrame:
    """Rows of finished loads that no merged load took over."""
    few = finished.select("load", "day", "replaces").limit(FEW_LOADS + 1).collect()
    if len(few) <= FEW_LOADS:
        return rows.where(_visible(few))
    done = finished.select("load", F.col("day").alias("_day"))
    gone = finished.select(F.col("day").alias("event_date"), F.explode("replaces").alias("load"))
    seen = rows.join(done, (rows["load"] == done["load"]) & (done["_day"].isNull() | (done["_day"] == rows["event_date"])), "left_semi")
    return seen.join(gone, ["event_date", "load"], "left_anti")


def _visible(finished: list) -> Column:
    """The ledger as a predicate on the partition columns, so that other folders aren't read.

    One term for each day with merged loads; those that were merged again are left out first.
    """
    day, load = F.col("event_date"), F.col("load")
    plain = {r["load"] for r in finished if r["day"] is None}
    merged, gone = defaultdict(set), defaultdict(set)
    for r in finished:
        if r["day"] is not None:
            merged[r["day"]].add(r["load"])
            gone[r["day"]].update(r["replaces"])
    seen = load.isin(sorted(plain))
    for d in sorted(merged):
        seen |= (day == F.lit(d)) & load.isin(sorted(merged[d] - gone[d]))
    for d in sorted(gone):
        if gone[d] & plain:
            seen &= ~(day.eqNullSafe(F.lit(d)) & load.isin(sorted(gone[d] & plain)))
    return seen
