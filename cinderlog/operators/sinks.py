"""Day-partitioned log table: append, compaction and reading back.

Layout: ``<path>/event_date=.../load=.../*.parquet`` and ``<path>/_loads/<load>``,
one small JSON file for each finished load. A load id names one batch of rows. Its
rows are visible once its file is there, all days at once; a load that broke off
isn't seen, and the next try writes over it. A load that has its file is never
written again, so a replay changes nothing, also after its rows were compacted
into another load. With an index, ``<path>/_terms/event_date=.../load=...`` holds
the load's postings; they are seen exactly when the load's rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cinderlog.functions import attributes, text
from cinderlog.operators import ledger, terms
from cinderlog.operators.ledger import commit as _commit, files as _files
from cinderlog.schema import LOG_DDL

# Sort order inside files; min/max statistics then skip row groups.
CLUSTER = ["service_name", "severity", "_hour", "timestamp"]


def table_rows(
    logs: DataFrame, promote: dict[str, list[str]] | None = None, with_terms: bool = False
) -> DataFrame:
    """Add the write-time columns: VARIANT attributes, day, promoted attributes, terms."""
    kinds = dict(logs.dtypes)
    for name in ("resource_attributes", "log_attributes"):
        if kinds[name] == "string":
            logs = logs.withColumn(name, F.parse_json(name))
    extra: dict[str, Column] = {"event_date": F.to_date("timestamp")}
    for name, keys in (promote or {}).items():
        extra[name] = attributes.attr_text(F.col("log_attributes"), keys)
    if with_terms:
        extra["body_terms"] = text.terms(F.col("body"))
    return logs.withColumns(extra)


def _clustered(rows: DataFrame, by_service: bool = True) -> DataFrame:
    """Group rows by day, and by service unless the load is small, for few, sorted files.

    Rebalancing joins small groups and splits those above the advisory
    partition size, so a day or service with much of the data still fills many
    tasks. Unlike range partitioning it does not sample, which would run the
    whole ingest a second time.
    """
    keys = ["event_date", "service_name"] if by_service else ["event_date"]
    grouped = rows.hint("rebalance", *map(F.col, keys))
    hour = F.date_trunc("hour", "timestamp")
    return grouped.withColumn("_hour", hour).sortWithinPartitions("event_date", *CLUSTER).drop("_hour")


def append_logs(
    logs: DataFrame,
    path: str,
    load: str,
    promote: dict[str, list[str]] | None = None,
    with_terms: bool = False,
    by_service: bool = True,
    index: str | None = None,
) -> None:
    """Append one load; nothing is written for an empty one.

    ``index`` names a text configuration: postings of the bodies' terms are written
    with the load, from its stored ids and bodies. Ids must be unique in the table then.

    Micro-batches should pass ``by_service=False``: one file per day, which
    ``compact_day`` later sorts out by service.
    """
    if ledger.is_committed(logs.sparkSession, path, load):
        return
    rows = table_rows(logs, promote, with_terms).withColumn("load", F.lit(load))
    ledger.drop_attempt(logs.sparkSession, path, load)
    _write(_clustered(rows, by_service), path)
    if index:
        _write_terms(terms.postings(_of_load(logs.sparkSession, path, load), index), path, load)
    _commit(logs.sparkSession, path, load, terms=index)


def _of_load(spark: SparkSession, path: str, load: str) -> DataFrame:
    """(id, timestamp, body) of the stored rows of one load, committed or not, dealt to all cores.

    The load's files are few and of unlike sizes, and finding terms is the load's most work.
    One task for each core: in smaller parts fewer postings grow before the shuffle.
    """
    rows = spark.read.schema(f"{LOG_DDL}, event_date date, load string").parquet(path).where(F.col("load") == load)
    return rows.select("id", "timestamp", "body").repartition(spark.sparkContext.defaultParallelism, "id")


def _write_terms(postings: DataFrame, path: str, load: str) -> None:
    """By day, sorted by term inside each file; a term of every row has no more than one row per bucket of ids."""
    rows = postings.withColumn("load", F.lit(load)).hint("rebalance", F.col("event_date"))
    (
        rows.sortWithinPartitions("event_date", "term", "bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date", "load")
        .parquet(f"{path}/_terms")
    )


def _write(rows: DataFrame, path: str) -> None:
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        # Lets a trace lookup skip row groups; the adaptive filter shrinks to fit.
        .option("parquet.bloom.filter.enabled#trace_id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .partitionBy("event_date", "load")
        .parquet(path)
    )


def writer_number(spark: SparkSession, path: str, writer: str) -> int:
    """A small number for ``writer`` that no other writer of the table has; the same one whenever it is asked.

    Numbers are files of ``<path>/_writers``. Who creates a number's file owns it. A
    writer that broke off in between leaves a number unused.
    """
    fs, at = _files(spark, path)
    home = at(f"{path}/_writers")
    fs.mkdirs(home)
    taken = {}
    for status in fs.listStatus(home):
        name = status.getPath().getName()
        if not name.startswith("."):
            number, _, owner = name.partition("=")
            taken[int(number)] = owner
    for number, owner in taken.items():
        if owner == writer:
            return number
    number = max(taken, default=-1) + 1
    while True:
        if ledger.make_once(fs, at(f"{path}/_writers/.{number}")):
            fs.create(at(f"{path}/_writers/{number}={writer}")).close()
            return number
        number += 1


def read_logs(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """Log table as written by ``append_logs``; ``extra`` lists promoted columns as DDL."""
    ddl = LOG_DDL + (f", {extra}" if extra else "") + ", event_date date, load string"
    return ledger.committed(spark.read.schema(ddl).parquet(path), ledger.loads(spark, path))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Postings of the visible loads that have an index."""
    fs, at = _files(spark, path)
    fs.mkdirs(at(f"{path}/_terms"))
    return ledger.committed(spark.read.schema(terms.POSTINGS_DDL).parquet(f"{path}/_terms"), ledger.loads(spark, path))


def split_by_index(spark: SparkSession, path: str, rows: DataFrame, config: str) -> tuple[DataFrame, DataFrame]:
    """Rows of loads that have an index of this configuration, and the others."""
    loads = ledger.loads(spark, path).where(F.col("terms") == config).select("load")
    few = [r["load"] for r in loads.limit(ledger.FEW_LOADS + 1).collect()]
    if len(few) <= ledger.FEW_LOADS:
        return rows.where(F.col("load").isin(few)), rows.where(~F.col("load").isin(few))
    return rows.join(loads, "load", "left_semi"), rows.join(loads, "load", "left_anti")


def compact_day(spark: SparkSession, path: str, day: str, load: str, extra: str = "") -> None:
    """Replace all loads of one closed day by a single sorted load.

    The new load is written beside the old ones and takes their place when it is
    committed, in one step. Until then, and after a crash, readers see the old
    ones. Their folders stay for readers that began before; ``sweep_day`` removes
    them. If all loads of the day have an index of one configuration, so has the new one:
    their postings are merged, no text is read again.
    """
    if ledger.is_committed(spark, path, load):
        return
    rows = read_logs(spark, path, extra).where(F.col("event_date") == F.lit(day).cast("date"))
    old = [r["load"] for r in rows.select("load").distinct().collect()]  # one short name per load of the day
    if old:
        _write(_clustered(rows.withColumn("load", F.lit(load))), path)
        kinds = ledger.loads(spark, path).where(F.col("load").isin(old)).select("terms").distinct().collect()
        index = kinds[0]["terms"] if len(kinds) == 1 else None
        if index:
            stored = read_terms(spark, path).where(F.col("event_date") == F.lit(day).cast("date"))
            _write_terms(terms.merge_postings(stored), path, load)
        _commit(spark, path, load, day, old, terms=index)


def sweep_day(spark: SparkSession, path: str, day: str) -> int:
    """Remove the folders of a day's replaced loads; returns how many went."""
    fs, at = _files(spark, path)
    gone = ledger.loads(spark, path).where(F.col("day") == F.lit(day).cast("date")).select(F.explode("replaces").alias("load")).distinct()
    homes = [at(f"{path}/event_date={day}/load={r['load']}") for r in gone.collect()]
    for r in gone.collect():
        fs.delete(at(f"{path}/_terms/event_date={day}/load={r['load']}"), True)
    return sum(fs.delete(home, True) for home in homes if fs.exists(home))
