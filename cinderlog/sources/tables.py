"""Views of the test tables as logs, payloads, producer events, spans and metrics.

Each view is a rule over a whole table. The same rules exist as DuckDB SQL in
``cinderlog.plans.oracle``; ``%`` tests below mark rows that a check must find,
they never narrow what is processed.
"""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cinderlog.sources import attribute_cases

SERVICE = "'svc-' || cast(user_id % 5 as string)"
SEVERITY = (
    "case event_type when 'view' then 'debug' when 'click' then 'info' when 'signup' then 'warn' "
    "when 'error' then 'error' else 'fatal' end"
)
BODY = "event_type || ' by user ' || cast(user_id as string)"
SPAN_ID = "substr(md5(cast(event_id as string)), 1, 16)"
SCHEMA_URL = "https://opentelemetry.io/schemas/1.21.0"

# Attribute object of an event, keys in order; {k} is the number inside props.
LOG_ATTRIBUTES = (
    "'{{\"duration_ms\":' || cast(cast(round(value * 100) as bigint) as string) || ',\"http.status_code\":' || "
    "cast(200 + 100 * (event_id % 4) as string) || ',\"k\":' || {k} || "
    "case when event_id % 11 = 0 then ',\"note\":null' else '' end || ',\"tags\":[\"' || "
    "'t' || cast(event_id % 3 as string) || '\",\"all\"],\"user\":{{\"id\":\"u_' || "
    "cast(user_id as string) || '\",\"role\":\"' || 'r' || cast(event_id % 7 as string) || "
    "'\"}},\"user_id\":\"u_' || cast(user_id as string) || '\"}}'"
)
RESOURCE_ATTRIBUTES = (
    "'{{\"host.name\":\"host-' || cast(user_id % 10 as string) || '\",\"service.version\":\"1.0.' || "
    "cast(event_id % 3 as string) || '\"}}'"
).format()

# Batches of 100 events; every seventh block of 1500 makes one oversized batch.
BLOCK = "cast(floor(event_id / 1500.0) as bigint)"
BATCH_ID = f"case when {BLOCK} % 7 = 3 then -1 - {BLOCK} else cast(floor(event_id / 100.0) as bigint) end"

MANY_KEYS = "{" + ",".join(f'"k{i:03d}":{i}' for i in range(101)) + "}"

# Event fields as sent, with faults at fixed distances.
SENT = {
    "time": "case when event_id % 971 = 17 then '' else '\"timestamp\":\"' || {ts} || 'Z\",' end",
    "severity": f"case when event_id % 997 = 5 then 'VERBOSE' else {SEVERITY} end",
    "service": f"case when event_id % 991 = 7 then '' when event_id % 953 = 23 then repeat('s', 256) else {SERVICE} end",
    "body": f"case when event_id % 983 = 11 then '' when event_id % 977 = 13 then repeat('é', 16385) else {BODY} end",
    "attributes": f"case when event_id % 967 = 19 then '{MANY_KEYS}' else {LOG_ATTRIBUTES} end",
    "span": f"case when event_id % 5 = 0 then '' else {SPAN_ID} end",
}


def sent_event(ts: str, k: str) -> str:
    """SQL for the JSON text of one sent event, valid in both dialects."""
    f = {name: text.format(ts=ts, k=k) if name in ("time",) else text for name, text in SENT.items()}
    f["attributes"] = f"case when event_id % 967 = 19 then '{MANY_KEYS}' else {LOG_ATTRIBUTES.format(k=k)} end"
    return (
        f"'{{' || {f['time']} || '\"service_name\":\"' || {f['service']} || '\",\"severity\":\"' || {f['severity']} || "
        f"'\",\"body\":\"' || {f['body']} || '\",\"span_id\":\"' || {f['span']} || "
        f"'\",\"resource_attributes\":{{}},\"log_attributes\":' || {f['attributes']} || '}}'"
    )


# Whole-payload faults over a joined list of events {e}.
PAYLOAD = (
    "case when batch_id % 41 = 40 then '{{\"events\":[' || {e} || ']' "
    "when batch_id % 43 = 42 then '{{\"events\":[{{\"timestamp\":5}}]}}' "
    "when batch_id % 47 = 45 then '{{\"events\":[]}}' "
    "when batch_id % 53 = 12 then 'null' "
    "else '{{\"events\":[' || {e} || ']}}' end"
)

def raw_attributes_sql() -> str:
    """SQL for one attribute object per event: the case of its id modulo 64."""
    cases = " ".join(f"when {slot} then {case.sent}" for slot, case in enumerate(attribute_cases.CASES))
    return f"replace(case event_id % 64 {cases} end, '@', cast(event_id as string))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt to all tasks by ``key``, before each of them grows into a wide one.

    A file may have fewer row groups than there are cores.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as log rows; attributes are JSON text."""
    trace = "md5(cast(user_id as string) || '-' || date_format(ts, 'yyyyMMddHH'))"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        "ts as timestamp",
        "ts + make_dt_interval(0, 0, 0, event_id % 30) as received_at",
        f"{SERVICE} as service_name",
        f"{SEVERITY} as severity",
        "event_type as severity_text",
        f"{BODY} as body",
        f"case when event_id % 10 = 0 then null else {trace} end as trace_id",
        f"{SPAN_ID} as span_id",
        f"{RESOURCE_ATTRIBUTES} as resource_attributes",
        LOG_ATTRIBUTES.format(k="get_json_object(props, '$.k')") + " as log_attributes",
        f"case when event_id % 4 = 0 then '{SCHEMA_URL}' end as schema_url",
        "cast(ts as date) as event_date",
    )


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as log rows for text search."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as id",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, doc_id % 20160) as timestamp",
        "source as service_name",
        "text as body",
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` packed into ingest payloads, one row per batch."""
    sent = sent_event("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")", "get_json_object(props, '$.k')")
    dealt = _spread(table(spark, sf_dir, "events").selectExpr("*", f"{BATCH_ID} as batch_id"), "batch_id")
    # Only the narrow rows move: they already lie by batch.
    rows = dealt.selectExpr("event_id", "batch_id", f"{sent} as e")
    # A batch is at most 1500 events by the rule above.
    grouped = rows.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "e"))).alias("_events"))
    joined = grouped.withColumn("_joined", F.concat_ws(",", F.transform("_events", lambda x: x["e"])))
    return joined.select("batch_id", F.expr(PAYLOAD.format(e="_joined")).alias("payload"))


@F.pandas_udf(T.BinaryType())
def _gzip(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: gzip.compress(bytes(b), 1, mtime=0))


def zipped_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same payloads as bytes: some zipped, some with a bad header, some cut off."""
    plain = payloads(spark, sf_dir).select("batch_id", F.encode("payload", "UTF-8").alias("raw"))
    kind = F.expr(
        "case when batch_id % 31 = 7 then 'header' when batch_id % 31 = 9 then 'cut' "
        "when batch_id % 2 = 0 then 'zip' else 'plain' end"
    )
    made = plain.withColumn("kind", kind).withColumn("z", _gzip("raw"))
    return made.select(
        "batch_id",
        F.when(F.col("kind").isin("header", "plain"), F.col("raw"))
        .when(F.col("kind") == "cut", F.expr("substring(z, 1, length(z) - 9)"))
        .otherwise(F.col("z"))
        .alias("body"),
        F.when(F.col("kind") == "plain", F.lit("")).otherwise(F.lit("gzip")).alias("encoding"),
    )


def raw_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attribute object per event as the sanitiser's input."""
    rows = _spread(table(spark, sf_dir, "events").select("event_id"), "event_id").selectExpr(
        f"{BATCH_ID} as batch_id", "event_id as event_index", f"{raw_attributes_sql()} as log_attributes"
    )
    return rows.withColumn("log_attributes", F.from_json("log_attributes", "map<string, variant>"))


def producer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a producer holds them: level, message and typed fields."""

    def field(key, kind, **values):
        cols = {
            "string_val": "cast(null as string)", "int64_val": "cast(null as bigint)",
            "float64_val": "cast(null as double)", "bool_val": "cast(null as boolean)",
            "json_val": "cast(null as string)",
        } | values
        parts = ", ".join(f"'{c}', {e}" for c, e in cols.items())
        return f"named_struct('key', '{key}', 'type', '{kind}', {parts})"

    fields = [
        field("trace_id", "string", string_val="md5(cast(user_id as string))"),
        field("k", "int64", int64_val="cast(get_json_object(props, '$.k') as bigint)"),
        field("value", "float64", float64_val="value"),
        field("dup", "string", string_val="'first'"),
        field("ok", "bool", bool_val="event_id % 2 = 0"),
        field("elapsed", "duration", int64_val="cast(round(value * 100) as bigint) * 10000"),
        field("error", "error", string_val="'quote \" slash \\\\ line\\n end'"),
        field("tags", "string_slice", json_val="'[\"t0\",\"all\"]'"),
        field("user", "object", json_val="'{\"id\":\"u_' || cast(user_id as string) || '\"}'"),
        field("blob", "any", json_val="'not json {'"),
        field("dup", "int64", int64_val="event_id"),
    ]
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        f"{SERVICE} as producer",
        "ts as timestamp",
        f"{SEVERITY} as severity",
        f"{BODY} as message",
        f"case when event_id % 13 = 0 then slice(array({', '.join(fields)}), 1, 0) "
        f"else array({', '.join(fields)}) end as fields",
    )


def block_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as spans: 64 events in a row make a trace, a ternary tree inside.

    Spans of place 50 and up name a parent that does not exist.
    """
    trace = "md5('t' || cast(cast(floor(event_id / 64.0) as bigint) as string))"
    parent = "event_id - event_id % 64 + cast(floor((event_id % 64 - 1) / 3.0) as bigint)"
    return table(spark, sf_dir, "events").selectExpr(
        f"{trace} as trace_id",
        f"{SPAN_ID} as span_id",
        "case when event_id % 64 = 0 then '' when event_id % 64 = 50 then 'missing' "
        f"else substr(md5(cast({parent} as string)), 1, 16) end as parent_span_id",
        f"{SERVICE} as service_name",
        "event_type as operation_name",
        "ts as start_time",
        "ts + make_dt_interval(0, 0, 0, cast(value as decimal(18, 6))) as end_time",
        "case when event_type = 'error' then 'ERROR' else 'OK' end as status",
    )


def log_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that some log rows were written in."""
    logs = event_logs(spark, sf_dir)
    return logs.where("trace_id is not null and severity <> 'debug'").selectExpr(
        "trace_id", "span_id", "severity_text as operation_name", "timestamp as start_time"
    )


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "ts as timestamp",
        "event_type as metric_name",
        "'GAUGE' as metric_type",
        "value",
        "map('tier', cast(user_id % 3 as string)) as labels",
        "'ms' as unit",
    )
