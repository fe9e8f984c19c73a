"""Streaming jobs. Each returns the started query; the caller waits or stops."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from cinderlog import fixed
from cinderlog.operators import ingest, partials, rollup, search, sinks


# Row ids of streams: ten bits for the writer, 23 for its micro-batch, 30 for the row's place in it.
WRITER_SHIFT, BATCH_SHIFT = 53, 30


def _trigger(writer: DataStreamWriter, seconds: int | None) -> DataStreamWriter:
    """Every ``seconds``, or once over what is there."""
    return writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)


def ingest_stream(
    payloads: DataFrame,
    logs_path: str,
    rejects_path: str,
    checkpoint: str,
    seconds: int | None = None,
    now: Column | None = None,
) -> StreamingQuery:
    """Decode, check and sanitise payloads and append them; rejects go to a dead-letter table.

    Both writes are keyed by the query and the micro-batch, so a replay rewrites the
    same folders, and neither another stream into the same table nor one that
    begins anew with a fresh checkpoint is taken for a replay. A checkpoint keeps its query's id.
    Row ids are the query's writer number, the micro-batch number and the row's place
    in it, unique without a pass over earlier loads. The checked batches are persisted
    and came without an exchange, so their rows keep their places.
    """
    spark = payloads.sparkSession
    known: dict[str, int] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if query not in known:
            known[query] = sinks.writer_number(spark, logs_path, query)
        load = f"{query}-{batch_id}"
        checked = ingest.check(ingest.decode(batch)).persist()
        try:
            base = known[query] << WRITER_SHIFT | batch_id << BATCH_SHIFT
            sinks.append_logs(ingest.to_log_rows(checked, base, now, materialize=False), logs_path, load, by_service=False)
            rejected = ingest.verdicts(checked).where(~F.col("accepted")).withColumn("load", F.lit(load))
            (
                rejected.write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("load")
                .parquet(rejects_path)
            )
        finally:
            checked.unpersist()

    writer = payloads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return _trigger(writer, seconds).start()


def hourly_counts_stream(
    logs: DataFrame, path: str, checkpoint: str, seconds: int | None = None, writer: str = "hourly"
) -> StreamingQuery:
    """Append additive partial counts of every micro-batch.

    There is no watermark: a row that comes late is counted like any other. A
    replayed micro-batch counts once, also after ``partials.compact``. ``writer`` names the
    stream in the table: a micro-batch of the same writer and number is a replay, so
    streams into one table need names of their own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        partials.append(rollup.hourly_counts(batch), path, writer, batch_id)

    job = logs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return _trigger(job, seconds).start()


def read_hourly_counts(spark: SparkSession, path: str) -> DataFrame:
    return rollup.merge_counts(partials.read(spark, path))


THROUGHPUT_DDL = "window_start timestamp_ntz, events bigint, load bigint"


def throughput_stream(
    logs: DataFrame, path: str, checkpoint: str, window_seconds: int = 10, delay: str = "10 minutes",
    seconds: int | None = None, ts: str = "timestamp",
) -> StreamingQuery:
    """Keep event counts of tumbling windows; rows later than ``delay`` are dropped.

    Update mode writes every changed window per micro-batch; the latest version
    of a window is the valid one.
    """
    at = logs.select(F.col(ts).cast("timestamp").alias("_ts"))
    counts = (
        at.withWatermark("_ts", delay)
        .groupBy(F.window("_ts", f"{int(window_seconds)} seconds"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "events")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/load={batch_id}")

    writer = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return _trigger(writer, seconds).start()


def read_throughput(spark: SparkSession, path: str, window_seconds: int = 10) -> DataFrame:
    versions = spark.read.schema(THROUGHPUT_DDL).parquet(path)
    latest = versions.groupBy("window_start").agg(F.max_by("events", "load").alias("events"))
    return latest.withColumn("rate", F.col("events") / F.lit(float(window_seconds)))


def tail_stream(
    logs: DataFrame, path: str, checkpoint: str, service_name: str | None = None, min_severity: str | None = None,
    keyword: str | None = None, seconds: int | None = None,
) -> StreamingQuery:
    """Follow new rows that pass the search filters; every input row is looked at once."""
    from cinderlog.functions import severity, text

    if seconds is not None and seconds not in fixed.REFRESH_SECONDS:
        raise ValueError(f"refresh must be one of {fixed.REFRESH_SECONDS} seconds")
    rows = logs
    if service_name:
        rows = rows.where(F.col("service_name") == service_name)
    if min_severity:
        rows = rows.where(severity.at_least(F.col("severity"), min_severity))
    if keyword:
        rows = rows.where(text.matches(F.col("body"), keyword))
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    return _trigger(writer, seconds or None).start()


def poll(logs: DataFrame, q: search.LogQuery) -> tuple[list, str | None]:
    """One refresh step: rows behind the query's cursor and the cursor of the last of them."""
    from cinderlog.functions.cursors import Cursor, encode

    rows, _ = search.fetch(logs, q)
    if rows:
        return rows, encode(Cursor(rows[-1]["timestamp"], rows[-1]["id"]))
    return rows, encode(q.cursor) if q.cursor else None


def dedup_stream(events: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Drop repeated deliveries that arrive within ``delay`` of each other.

    State holds one key and its expiry per event of the last ``delay``. A row with a
    NULL in its key has no key and passes.
    """
    known = reduce(and_, (F.col(k).isNotNull() for k in keys))
    timed = events.withWatermark(ts, delay)
    return timed.where(known).dropDuplicatesWithinWatermark(keys).unionByName(timed.where(~known))
