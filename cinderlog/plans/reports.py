"""Rollup, operations and retention queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderlog.fixed import ROLLUP_RETENTION_DAYS
from cinderlog.functions import attributes
from cinderlog.functions.times import ntz
from cinderlog.operators import reconcile, reports, retention, rollup
from cinderlog.plans import oracle
from cinderlog.plans.registry import query
from cinderlog.session import scratch_path
from cinderlog.sources import tables

AS_OF = "2024-01-31 00:00:00"
HOURLY = """SELECT service_name, severity, date_trunc('hour', "timestamp") AS hour, count(*) AS count
  FROM logs GROUP BY ALL"""


def _logs(spark, sf_dir):
    return tables.event_logs(spark, sf_dir)


@query("hourly_counts", oracle.logs(HOURLY))
def hourly_counts(spark, sf_dir):
    return rollup.hourly_counts(_logs(spark, sf_dir))


@query("merge_hourly_counts", oracle.logs(HOURLY))
def merge_hourly_counts(spark, sf_dir):
    """Partials of many small loads, written first, then merged."""
    path = scratch_path(spark, "partials")
    loads = _logs(spark, sf_dir).withColumn("load", F.col("id") % 7)
    partials = loads.groupBy("load", "service_name", "severity", F.date_trunc("hour", "timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("count")
    )
    partials.withColumn("hour", F.col("hour").cast("timestamp_ntz")).write.parquet(path)
    return rollup.merge_counts(spark.read.parquet(path))


@query(
    "severity_facets",
    oracle.logs(
        """SELECT d.severity, d.ordinal, count(l.id) AS count
          FROM (VALUES ('debug', 0), ('info', 1), ('warn', 2), ('error', 3), ('fatal', 4)) d(severity, ordinal)
          LEFT JOIN logs l USING (severity) GROUP BY ALL"""
    ),
)
def severity_facets(spark, sf_dir):
    return rollup.severity_facets(rollup.hourly_counts(_logs(spark, sf_dir)))


@query(
    "ingest_freshness",
    oracle.logs(
        f"""SELECT count(*) AS recent, max(received_at) AS newest,
          epoch_us(TIMESTAMP '{AS_OF}') / 1e6 - epoch_us(max(received_at)) / 1e6 AS lag_seconds
          FROM logs WHERE received_at > TIMESTAMP '{AS_OF}' - INTERVAL 60 MINUTE"""
    ).replace(
        f"epoch_us(TIMESTAMP '{AS_OF}') / 1e6 - epoch_us(max(received_at)) / 1e6",
        f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(received_at))) / 1e6",
    ),
)
def ingest_freshness(spark, sf_dir):
    return reports.ingest_freshness(_logs(spark, sf_dir), ntz(AS_OF), 60)


@query(
    "minute_gaps",
    oracle.logs(
        """SELECT m AS minute, count(id) AS event_count
          FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 MINUTE)) AS m)
          LEFT JOIN logs ON date_trunc('minute', "timestamp") = m GROUP BY m"""
    ),
)
def minute_gaps(spark, sf_dir):
    return reports.minute_gaps(_logs(spark, sf_dir), "2024-01-01 00:00:00", "2024-01-31 00:00:00")


@query(
    "schema_violation_count",
    oracle.logs("""SELECT count(*) FILTER (WHERE service_name IS NULL OR body IS NULL) AS violations
      FROM (SELECT body, CASE WHEN id % 19 <> 4 THEN service_name END AS service_name FROM logs)"""),
)
def schema_violation_count(spark, sf_dir):
    """Rows without service or body, where some events have lost their service."""
    lost = F.when(F.col("id") % 19 != 4, F.col("service_name"))
    return reports.schema_violations(_logs(spark, sf_dir).withColumn("service_name", lost))


@query(
    "write_throughput",
    oracle.logs("""SELECT date_trunc('second', received_at) AS second, count(*) AS events_per_second
      FROM logs GROUP BY ALL"""),
)
def write_throughput(spark, sf_dir):
    return reports.write_throughput(_logs(spark, sf_dir))


@query(
    "partition_stats",
    oracle.logs("""SELECT event_date, count(*) AS rows,
        cast(sum(octet_length(encode(body)) + octet_length(encode(log_attributes))) AS bigint) AS content_bytes
      FROM logs GROUP BY event_date ORDER BY event_date DESC LIMIT 14"""),
)
def partition_stats(spark, sf_dir):
    return reports.partition_stats(_logs(spark, sf_dir))


@query(
    "partition_coverage",
    oracle.logs("""SELECT cast(d AS date) AS missing_date
      FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-20', TIMESTAMP '2024-02-10', INTERVAL 1 DAY)) AS d)
      WHERE cast(d AS date) NOT IN (SELECT event_date FROM logs)"""),
)
def partition_coverage(spark, sf_dir):
    return reports.partition_coverage(_logs(spark, sf_dir), "2024-01-20", "2024-02-10")


@query(
    "ingest_lag",
    oracle.logs("""SELECT service_name, count(*) AS rows, sum(us) / count(*) / 1e6 AS avg_lag_seconds,
        max(us) / 1e6 AS max_lag_seconds, max(us) FILTER (WHERE pos = n * 95 // 100) / 1e6 AS p95_lag_seconds
      FROM (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY us) - 1 AS pos,
              count(*) OVER (PARTITION BY service_name) AS n
            FROM (SELECT service_name, cast(epoch_us(received_at) - epoch_us("timestamp") AS double) AS us FROM logs))
      GROUP BY service_name"""),
)
def ingest_lag(spark, sf_dir):
    return reports.ingest_lag(_logs(spark, sf_dir))


def _requests(spark, sf_dir):
    """Completed requests: status and duration are read from the attributes."""
    attrs = attributes.as_variant(F.col("log_attributes"))
    return tables.event_logs(spark, sf_dir).select(
        "service_name",
        "timestamp",
        attributes.attr(attrs, "http.status_code", "int").alias("status"),
        attributes.attr(attrs, "duration_ms", "bigint").alias("duration_ms"),
    )


_SUMMARY = """summary AS (
  SELECT service_name, count(*) AS requests, count(*) FILTER (WHERE status >= 500) AS errors,
    count(*) FILTER (WHERE status >= 500) / count(*) AS error_rate,
    count(*) / ((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1e6) AS rate,
    max(duration_ms) FILTER (WHERE pos = n * 95 // 100) AS p95_ms
  FROM (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY duration_ms) - 1 AS pos,
          count(*) OVER (PARTITION BY service_name) AS n
        FROM (SELECT service_name, "timestamp", 200 + 100 * (id % 4) AS status,
                cast(json_extract(log_attributes, '$.duration_ms') AS bigint) AS duration_ms FROM logs))
  GROUP BY service_name)"""


@query("latency_summary", oracle.logs("SELECT * FROM summary").replace("\nSELECT * FROM", f",\n{_SUMMARY}\nSELECT * FROM"))
def latency_summary(spark, sf_dir):
    return reports.latency_summary(_requests(spark, sf_dir))


@query(
    "slo_check",
    f"""WITH {oracle.LOGS}, {_SUMMARY}
      SELECT service_name, metric, p95_ms < max_p95_ms AS p95_ok, error_rate < 0.25 AS errors_ok,
        p95_ms < max_p95_ms AND error_rate < 0.25 AS passed
      FROM summary, (VALUES ('ingest', 500), ('query', 200), ('slow', 100000)) o(metric, max_p95_ms)""",
)
def slo_check(spark, sf_dir):
    return reports.slo_check(
        reports.latency_summary(_requests(spark, sf_dir)), {"ingest": 500, "query": 200, "slow": 100000}, 0.25
    )


@query(
    "throughput_windows",
    oracle.logs("""SELECT to_timestamp(floor(epoch_us("timestamp") / 1e7) * 10)::timestamp AS window_start,
      count(*) AS events, count(*) / 10.0::double AS rate FROM logs GROUP BY 1"""),
)
def throughput_windows(spark, sf_dir):
    return reports.throughput_windows(_logs(spark, sf_dir))


@query(
    "throughput_summary",
    oracle.logs("""SELECT cast(sum(n) AS bigint) AS events, max(w) - min(w) + 1 AS windows,
        max(n) / 10.0::double AS peak_rate, sum(n) / ((max(w) - min(w) + 1) * 10.0::double) AS mean_rate
      FROM (SELECT epoch_us("timestamp") // 10000000 AS w, count(*) AS n FROM logs GROUP BY 1)"""),
)
def throughput_summary(spark, sf_dir):
    return reports.throughput_summary(reports.throughput_windows(_logs(spark, sf_dir)))


@query(
    "reconcile_events",
    oracle.logs("""SELECT severity AS marker, count(*) AS expected,
        cast(sum((id % 97 <> 0)::int * (1 + (id % 89 = 0)::int)) AS bigint) + count(*) FILTER (WHERE id % 101 = 0)
          AS stored,
        count(*) FILTER (WHERE id % 97 = 0) AS missing,
        count(*) FILTER (WHERE id % 97 <> 0 AND id % 89 = 0) AS duplicated,
        count(*) FILTER (WHERE id % 101 = 0) AS unexpected,
        count(*) FILTER (WHERE id % 97 <> 0 AND id % 83 = 0) AS altered,
        count(*) FILTER (WHERE id % 97 = 0 OR id % 89 = 0 OR id % 101 = 0 OR id % 83 = 0) = 0 AS passed
      FROM logs GROUP BY severity"""),
)
def reconcile_events(spark, sf_dir):
    """What was sent against a store that lost, repeated, changed and invented some rows."""
    sent = _logs(spark, sf_dir).select(
        F.col("severity").alias("marker"), F.col("id").alias("sequence"), "service_name", "body"
    )
    copies = F.when(F.col("sequence") % 97 == 0, 0).when(F.col("sequence") % 89 == 0, 2).otherwise(1)
    kept = sent.select("*", F.explode(F.array_repeat(F.lit(1), copies)).alias("_c")).drop("_c")
    altered = F.when(F.col("sequence") % 83 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    invented = sent.where(F.col("sequence") % 101 == 0).withColumn("sequence", -1 - F.col("sequence"))
    stored = kept.withColumn("body", altered).unionByName(invented)
    compared = reconcile.compare_events(sent, stored, ["marker", "sequence"], ["service_name", "body"])
    return reconcile.reconcile(compared, ["marker"])


@query(
    "retention_partitions",
    oracle.logs("""SELECT event_date, count(*) AS rows,
      event_date::timestamp < TIMESTAMP '2024-01-28 15:00:00' - INTERVAL 14 DAY AS dropped FROM logs GROUP BY ALL"""),
)
def retention_partitions(spark, sf_dir):
    return retention.by_partition_start(_logs(spark, sf_dir), ntz("2024-01-28 15:00:00"))


@query(
    "retention_ttl",
    oracle.logs("""SELECT event_date, count(*) AS rows, max("timestamp") AS newest,
      max("timestamp") + INTERVAL 14 DAY < TIMESTAMP '2024-01-28 15:00:00' AS dropped FROM logs GROUP BY event_date"""),
)
def retention_ttl(spark, sf_dir):
    return retention.by_row_age(_logs(spark, sf_dir), ntz("2024-01-28 15:00:00"))


@query(
    "retention_rollup_ttl",
    oracle.logs("""SELECT event_date, count(*) AS rows, max(hour) AS newest,
        max(hour) + INTERVAL 30 DAY < TIMESTAMP '2024-02-10 12:00:00' AS dropped
      FROM (SELECT DISTINCT service_name, severity, date_trunc('hour', "timestamp") AS hour, event_date FROM logs)
      GROUP BY event_date"""),
)
def retention_rollup_ttl(spark, sf_dir):
    counts = rollup.hourly_counts(_logs(spark, sf_dir)).withColumn("event_date", F.to_date("hour"))
    return retention.by_row_age(counts, ntz("2024-02-10 12:00:00"), ROLLUP_RETENTION_DAYS, ts="hour")
