"""Ingest, sanitising and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderlog.fixed import LOG_COLUMNS
from cinderlog.functions import keys, severity
from cinderlog.functions.times import ntz
from cinderlog.sources.attribute_cases import CASES
from cinderlog.operators import dedup, ingest, sanitize, sinks
from cinderlog.plans import oracle
from cinderlog.plans.registry import query
from cinderlog.session import scratch_path
from cinderlog.sources import tables
from cinderlog.sources.payloads import inflate

NOW = "2024-02-01 00:00:00"
SIZE_LIMIT = 40_000


@query(
    "ingest_decode",
    oracle.sent(
        """SELECT batch_id, event_index, "timestamp", service_name, severity, md5(body) AS body_md5, span_id,
          CASE WHEN many_keys THEN 101 ELSE 6 + cast(event_id % 11 = 0 AS int) END AS n_attributes FROM placed"""
    ),
)
def ingest_decode(spark, sf_dir):
    events = ingest.decoded_events(ingest.decode(tables.payloads(spark, sf_dir)))
    return events.select(
        "batch_id", F.col("event_index").cast("bigint"), "timestamp", "service_name", "severity",
        F.md5("body").alias("body_md5"), "span_id", F.size("log_attributes").alias("n_attributes"),
    )


@query(
    "ingest_gzip",
    oracle.sent(
        """SELECT batch_id,
          CASE WHEN batch_id % 31 = 7 THEN 'invalid-encoding'
               WHEN octet_length(encode(payload)) > 40000 AND (batch_id % 2 = 0 OR batch_id % 31 = 9)
                 THEN 'payload-too-large'
               WHEN batch_id % 31 = 9 THEN 'invalid-json' END AS problem,
          CASE WHEN batch_id % 31 IN (7, 9) OR (octet_length(encode(payload)) > 40000 AND batch_id % 2 = 0) THEN NULL
               ELSE md5(payload) END AS payload_md5 FROM texts"""
    ),
)
def ingest_gzip(spark, sf_dir):
    """Inflate byte payloads; the limit cuts zipped ones off while inflating."""
    read = inflate(tables.zipped_payloads(spark, sf_dir), SIZE_LIMIT)
    return read.select("batch_id", "problem", F.md5("payload").alias("payload_md5"))


@query(
    "ingest_size_guard",
    oracle.sent(
        """SELECT batch_id, octet_length(encode(payload)) AS payload_bytes,
          CASE WHEN octet_length(encode(payload)) > 40000 THEN 'payload-too-large' END AS problem FROM texts"""
    ),
)
def ingest_size_guard(spark, sf_dir):
    guarded = ingest.size_guard(tables.payloads(spark, sf_dir), SIZE_LIMIT)
    return guarded.select("batch_id", F.col("payload_bytes").cast("bigint"), "problem")


def _checked(spark, sf_dir):
    return ingest.check(ingest.decode(tables.payloads(spark, sf_dir)))


@query(
    "ingest_validate",
    oracle.checked(
        """SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY event_index, place) - 1
          AS violation_index, field, message FROM found"""
    ),
)
def ingest_validate(spark, sf_dir):
    found = ingest.violations(_checked(spark, sf_dir))
    return found.withColumn("violation_index", F.col("violation_index").cast("bigint"))


@query(
    "ingest_batch_verdict",
    oracle.checked("SELECT batch_id, problem IS NULL AS accepted, problem, n_events, n_violations FROM verdicts"),
)
def ingest_batch_verdict(spark, sf_dir):
    return ingest.verdicts(_checked(spark, sf_dir))


@query(
    "ingest_ack",
    oracle.checked(
        """SELECT md5(cast(batch_id AS varchar)) AS batch_id, n_events AS accepted, 500 AS estimated_processing_ms
          FROM verdicts WHERE problem IS NULL"""
    ),
)
def ingest_ack(spark, sf_dir):
    return ingest.acks(_checked(spark, sf_dir))


_ROUND = "replace(CASE event_id % 64 " + " ".join(
    f"WHEN {slot} THEN {case.clean}" for slot, case in enumerate(CASES)) + " END, '@', cast(event_id AS varchar))"

_WARNED = "(VALUES " + ", ".join(
    f"({slot}, {i}, '{kind}', {path})" for slot, case in enumerate(CASES) for i, (kind, path) in enumerate(case.warned)
) + ") w(slot, warning_index, kind, path)"


@query("attr_sanitize", f"SELECT event_id, md5({_ROUND}) AS attributes_md5 FROM events")
def attr_sanitize(spark, sf_dir):
    clean = sanitize.sanitize_column(tables.raw_attributes(spark, sf_dir), "log_attributes")
    return clean.select(F.col("event_index").alias("event_id"), F.md5("log_attributes").alias("attributes_md5"))


@query(
    "attr_sanitize_warnings",
    f"""SELECT {tables.BATCH_ID} AS batch_id, event_id AS event_index, warning_index, kind, path
      FROM events JOIN {_WARNED} ON event_id % 64 = slot""",
)
def attr_sanitize_warnings(spark, sf_dir):
    clean = sanitize.sanitize_column(tables.raw_attributes(spark, sf_dir), "log_attributes")
    return sanitize.warnings(clean)


@query(
    "null_normalize",
    oracle.checked(
        """SELECT batch_id, event_index, nullif(span_id, '') AS span_id, NULL::varchar AS trace_id,
          NULL::varchar AS schema_url, NULL::varchar AS resource_attributes, log_attributes FROM placed"""
    ),
)
def null_normalize(spark, sf_dir):
    decoded = ingest.decoded_events(ingest.decode(tables.payloads(spark, sf_dir)))
    text = decoded.withColumns({c: F.to_json(c) for c in ("resource_attributes", "log_attributes")})
    return ingest.null_normalize(text).select(
        "batch_id", F.col("event_index").cast("bigint"), "span_id", "trace_id", "schema_url",
        "resource_attributes", "log_attributes",
    )


@query(
    "assign_id_received",
    oracle.checked(
        f"""SELECT batch_id, event_index, event_index AS id_in_batch, "timestamp",
          TIMESTAMP '{NOW}' AS received_at, service_name, severity, body,
          NULL::bigint AS ids, NULL::bigint AS first_id, NULL::bigint AS last_id FROM accepted
          UNION ALL
          SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*), 5001, 5000 + count(*) FROM accepted"""
    ),
)
def assign_id_received(spark, sf_dir):
    """Which ids a batch gets depends on the run; their steps and, in a last row, their range do not."""
    rows = ingest.stamp_received(ingest.assign_ids(ingest.clean_events(_checked(spark, sf_dir)), base=5000), ntz(NOW))
    batches = rows.groupBy("batch_id").agg(F.min("id").alias("_low"))
    whole = rows.agg(
        F.count_distinct("id").alias("ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )
    steps = rows.join(batches, "batch_id").select(
        "batch_id", F.col("event_index").cast("bigint"), (F.col("id") - F.col("_low")).alias("id_in_batch"),
        "timestamp", "received_at", "service_name", "severity", "body",
    )
    return steps.unionByName(whole, allowMissingColumns=True)


_STORED = oracle.logs(
    """SELECT id, "timestamp", received_at, service_name, severity, body, trace_id, log_attributes,
      event_date, 'u_' || split_part(body, ' by user ', 2) AS user_attr FROM logs"""
)
_PROMOTE = {"user_attr": ["user_id"]}


def _stored(spark, path):
    return sinks.read_logs(spark, path, "user_attr string").select(
        "id", "timestamp", "received_at", "service_name", "severity", "body", "trace_id",
        F.to_json("log_attributes").alias("log_attributes"), "event_date", "user_attr",
    )


@query("sink_append", _STORED)
def sink_append(spark, sf_dir):
    """Write the log table and read it back."""
    path = scratch_path(spark, "logs")
    sinks.append_logs(tables.event_logs(spark, sf_dir).select(*LOG_COLUMNS), path, "a", _PROMOTE)
    return _stored(spark, path)


@query("sink_replay", _STORED)
def sink_replay(spark, sf_dir):
    """Two loads, the second delivered twice, the first day compacted, then all delivered again."""
    path = scratch_path(spark, "logs")
    logs = tables.event_logs(spark, sf_dir).select(*LOG_COLUMNS)
    early = F.col("timestamp") < ntz("2024-01-01 12:00:00")
    sinks.append_logs(logs.where(early), path, "a", _PROMOTE)
    for _ in range(2):  # a replayed load replaces itself
        sinks.append_logs(logs.where(~early), path, "b", _PROMOTE)
    sinks.compact_day(spark, path, "2024-01-01", "packed", "user_attr string")
    sinks.append_logs(logs.where(early), path, "a", _PROMOTE)
    sinks.sweep_day(spark, path, "2024-01-01")
    sinks.append_logs(logs.where(~early), path, "b", _PROMOTE)
    return _stored(spark, path)


@query(
    "dedup_idempotent",
    oracle.logs("SELECT id, \"timestamp\", service_name, body, 0::bigint AS delivery FROM logs"),
)
def dedup_idempotent(spark, sf_dir):
    """Each event is delivered one to three times; the first delivery wins."""
    logs = tables.event_logs(spark, sf_dir).select("id", "timestamp", "service_name", "body")
    sent = logs.withColumn("delivery", F.explode(F.sequence(F.lit(0), F.col("id") % 3)))
    return dedup.dedup(sent, ["id"], ["delivery"])


@query(
    "severity_normalize",
    """SELECT event_id, raw AS severity_text,
      CASE WHEN raw = 'warning' THEN 'warn' WHEN raw = 'error' THEN 'error' ELSE 'info' END AS severity,
      raw IN ('warning', 'error') AS recognised,
      CASE WHEN raw = 'warning' THEN 2 WHEN raw = 'error' THEN 3 ELSE 1 END AS ordinal
      FROM (SELECT event_id, CASE event_type WHEN 'signup' THEN 'warning' ELSE event_type END AS raw FROM events)""",
)
def severity_normalize(spark, sf_dir):
    raw = F.when(F.col("event_type") == "signup", F.lit("warning")).otherwise(F.col("event_type"))
    rows = tables.table(spark, sf_dir, "events").select("event_id", raw.alias("severity_text"))
    level = severity.normalize(F.col("severity_text"))
    return rows.select(
        "event_id", "severity_text", level["severity"].alias("severity"), level["recognised"].alias("recognised"),
        severity.ordinal(level["severity"]).alias("ordinal"),
    )


@query(
    "attr_clean_keys",
    r"""SELECT doc_id, word, CASE WHEN word = '' THEN '_' ELSE substr(regexp_replace(list_aggregate(list_transform(
          string_split(word, ''), lambda c: CASE WHEN regexp_full_match(c, '[A-Za-z0-9_.]') THEN c
          ELSE repeat('_', cast(octet_length(encode(c)) AS int)) END), 'string_agg', ''), '^[^A-Za-z]', '_'), 1, 255) END AS cleaned
        FROM (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS word FROM documents)""",
)
def attr_clean_keys(spark, sf_dir):
    """Key cleaning over every word of the documents, empty and over-long ones included."""
    words = tables.table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word")
    )
    return words.select("doc_id", "word", keys.clean_key(F.col("word")).alias("cleaned"))
