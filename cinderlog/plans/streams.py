"""Streaming jobs run over the whole tables until all input is used."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cinderlog.functions.times import ntz
from cinderlog.operators import ingest, partials, rollup
from cinderlog.operators.sinks import read_logs
from cinderlog.plans import oracle
from cinderlog.plans.ingest import NOW
from cinderlog.plans.registry import query
from cinderlog.plans.reports import HOURLY
from cinderlog.session import scratch_path
from cinderlog.sources import tables, topic
from cinderlog.streaming import jobs

FILES, FILES_PER_TRIGGER = 16, 8
ROLLUP_AS_OF = "2024-02-10 12:00:00"


def _arriving(spark, rows, label, files=FILES, files_per_trigger=FILES_PER_TRIGGER):
    """Write rows as several files and open them as a stream, by default of two micro-batches."""
    path = scratch_path(spark, label)
    # Small row groups, so that more tasks than files can read a micro-batch.
    rows.repartition(files).write.option("parquet.block.size", 8 << 20).parquet(path)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return topic.folder_payloads(spark, path, schema=ddl, files_per_trigger=files_per_trigger)


@query(
    "source_stream_logs",
    oracle.sent("""SELECT batch_id, event_index, "timestamp", service_name, span_id FROM placed"""),
)
def source_stream_logs(spark, sf_dir):
    """Decode payloads as they arrive, without any check, into a table."""
    arriving = _arriving(spark, tables.payloads(spark, sf_dir), "topic")
    events = ingest.decoded_events(ingest.decode(arriving)).select(
        "batch_id", F.col("event_index").cast("bigint"), "timestamp", "service_name", "span_id"
    )
    path = scratch_path(spark, "decoded")
    job = (
        events.writeStream.format("parquet")
        .option("checkpointLocation", scratch_path(spark, "ckpt"))
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return spark.read.schema(events.schema).parquet(path)


def _run_ingest(spark, sf_dir):
    logs, rejects = scratch_path(spark, "stream-logs"), scratch_path(spark, "stream-rejects")
    arriving = _arriving(spark, tables.payloads(spark, sf_dir), "payloads")
    jobs.ingest_stream(arriving, logs, rejects, scratch_path(spark, "ckpt"), now=ntz(NOW)).awaitTermination()
    return logs, rejects


@query(
    "stream_ingest",
    oracle.checked(
        f"""SELECT "timestamp", TIMESTAMP '{NOW}' AS received_at, service_name, severity, body,
          nullif(span_id, '') AS span_id, log_attributes, true AS id_is_unique FROM accepted"""
    ),
)
def stream_ingest(spark, sf_dir):
    logs, _ = _run_ingest(spark, sf_dir)
    stored = read_logs(spark, logs)
    copies = stored.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    return stored.join(copies, "id").select(
        "timestamp", "received_at", "service_name", "severity", "body", "span_id",
        F.to_json("log_attributes").alias("log_attributes"), (F.col("_n") == 1).alias("id_is_unique"),
    )


@query(
    "stream_ingest_rejects",
    oracle.checked("SELECT batch_id, problem, n_events, n_violations FROM verdicts WHERE problem IS NOT NULL"),
)
def stream_ingest_rejects(spark, sf_dir):
    """The dead-letter side of the same job."""
    _, rejects = _run_ingest(spark, sf_dir)
    ddl = "batch_id bigint, problem string, n_events bigint, n_violations bigint"
    return spark.read.schema(ddl).parquet(rejects).drop("load")


@query("stream_hourly_counts", oracle.logs(HOURLY))
def stream_hourly_counts(spark, sf_dir):
    """Rows arrive out of order over several micro-batches; all of them count."""
    logs = tables.event_logs(spark, sf_dir).select("service_name", "severity", "timestamp")
    path = scratch_path(spark, "partials")
    jobs.hourly_counts_stream(_arriving(spark, logs, "rows"), path, scratch_path(spark, "ckpt")).awaitTermination()
    return jobs.read_hourly_counts(spark, path)


@query(
    "rollup_compact",
    oracle.logs(f"""SELECT service_name, severity, hour, count FROM ({HOURLY})
      QUALIFY max(hour) OVER (PARTITION BY hour::date) + INTERVAL 30 DAY >= TIMESTAMP '{ROLLUP_AS_OF}'"""),
)
def rollup_compact(spark, sf_dir):
    """Four micro-batches merged by twos over two tiers, swept and expired; then the last micro-batch comes again."""
    logs = tables.event_logs(spark, sf_dir).select("service_name", "severity", "timestamp")
    path = scratch_path(spark, "partials")
    arriving = _arriving(spark, logs, "rows", files=4, files_per_trigger=1)
    jobs.hourly_counts_stream(arriving, path, scratch_path(spark, "ckpt")).awaitTermination()
    partials.compact(spark, path, fanout=2)
    partials.expire(spark, path, dt.datetime.fromisoformat(ROLLUP_AS_OF))
    partials.sweep(spark, path)
    partials.append(rollup.hourly_counts(logs), path, "hourly", 3)
    return jobs.read_hourly_counts(spark, path)


@query(
    "stream_throughput",
    oracle.logs("""SELECT to_timestamp(epoch_us("timestamp") // 10000000 * 10)::timestamp AS window_start,
      count(*) AS events, count(*) / 10.0::double AS rate FROM logs GROUP BY 1"""),
)
def stream_throughput(spark, sf_dir):
    """Unordered arrival needs a delay as long as the data spans, or rows would be dropped."""
    logs = tables.event_logs(spark, sf_dir).select("timestamp")
    path = scratch_path(spark, "windows")
    jobs.throughput_stream(
        _arriving(spark, logs, "rows"), path, scratch_path(spark, "ckpt"), delay="60 days"
    ).awaitTermination()
    return jobs.read_throughput(spark, path)


@query(
    "tail_logs",
    oracle.logs("""SELECT id, "timestamp", service_name, severity, body FROM logs
      WHERE service_name = 'svc-3' AND severity IN ('warn', 'error', 'fatal')"""),
)
def tail_logs(spark, sf_dir):
    logs = tables.event_logs(spark, sf_dir).select("id", "timestamp", "service_name", "severity", "body")
    path = scratch_path(spark, "tail")
    jobs.tail_stream(
        _arriving(spark, logs, "rows"), path, scratch_path(spark, "ckpt"), "svc-3", "warn"
    ).awaitTermination()
    return spark.read.schema(logs.schema).parquet(path)


@query("stream_dedup", oracle.logs('SELECT id, "timestamp", service_name FROM logs'))
def stream_dedup(spark, sf_dir):
    """Every row is delivered up to three times, in any file."""
    logs = tables.event_logs(spark, sf_dir).select("id", F.col("timestamp").cast("timestamp"), "service_name")
    sent = logs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("id") % 3))).drop("copy")
    once = jobs.dedup_stream(_arriving(spark, sent, "rows"), ["id"], "timestamp", "60 days")
    path = scratch_path(spark, "once")
    job = (
        once.writeStream.format("parquet")
        .option("checkpointLocation", scratch_path(spark, "ckpt"))
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return spark.read.schema(logs.schema).parquet(path).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
