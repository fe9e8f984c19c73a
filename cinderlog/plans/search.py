"""Filter, attribute, text and paging queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cinderlog.fixed import LOG_COLUMNS
from cinderlog.functions import attributes, cursors, severity, text, times
from cinderlog.functions.cursors import Cursor
from cinderlog.operators import reports, search, sinks, stored, terms
from cinderlog.plans import oracle
from cinderlog.plans.registry import query
from cinderlog.session import scratch_path
from cinderlog.sources import tables

COLS = (
    'id, "timestamp", received_at, service_name, severity, severity_text, body, trace_id, span_id, '
    "resource_attributes, log_attributes, schema_url"
)
START, END = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12, 12)
BETWEEN = "\"timestamp\" BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'"
AS_OF = dt.datetime(2024, 1, 31)


def _filter(name, where, condition):
    """A filter query over all log rows: ``where`` in SQL, ``condition`` as a column."""

    @query(name, oracle.logs(f"SELECT {COLS} FROM logs WHERE {where}"))
    def job(spark, sf_dir):
        return tables.event_logs(spark, sf_dir).where(condition()).select(*LOG_COLUMNS)

    return job


@query("select_log_columns", oracle.logs(f"SELECT {COLS} FROM logs"))
def select_log_columns(spark, sf_dir):
    return tables.event_logs(spark, sf_dir).select(*LOG_COLUMNS)


@query(
    "read_back_render",
    oracle.logs(
        """SELECT cast(id AS varchar) AS id, "timestamp", received_at, service_name, severity, severity_text, body,
          coalesce(trace_id, '') AS trace_id, span_id, resource_attributes, log_attributes,
          coalesce(schema_url, '') AS schema_url FROM logs"""
    ),
)
def read_back_render(spark, sf_dir):
    return search.read_back(tables.event_logs(spark, sf_dir))


@query(
    "read_back_json",
    oracle.logs(
        """SELECT id, rtrim(strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f'), '0') || 'Z' AS ts,
          trace_id, span_id IS NOT NULL AS has_span, schema_url, 'u_' || split_part(body, ' by user ', 2) AS user_id
          FROM logs"""
    ),
)
def read_back_json(spark, sf_dir):
    """The response objects, read again: absent fields are left out, attributes nest."""
    shown = search.response_json(tables.event_logs(spark, sf_dir))
    return shown.select(
        "id",
        F.get_json_object("event", "$.timestamp").alias("ts"),
        F.get_json_object("event", "$.trace_id").alias("trace_id"),
        F.array_contains(F.json_object_keys("event"), "span_id").alias("has_span"),
        F.get_json_object("event", "$.schema_url").alias("schema_url"),
        F.get_json_object("event", "$.log_attributes.user.id").alias("user_id"),
    )


def _attrs(name="log_attributes"):
    return attributes.as_variant(F.col(name))


_filter("filter_time_range", BETWEEN, lambda: search.in_time_range(START, END))
_filter("filter_service", "service_name = 'svc-0'", lambda: F.col("service_name") == "svc-0")
_filter("filter_severity", "severity = 'error'", lambda: F.col("severity") == "error")
_filter(
    "filter_min_severity", "severity IN ('warn', 'error', 'fatal')",
    lambda: severity.at_least(F.col("severity"), "warn"),
)
_filter(
    "filter_cursor", "(\"timestamp\", id) > (TIMESTAMP '2024-01-15 00:00:00', 4000)",
    lambda: search.after_cursor(Cursor(dt.datetime(2024, 1, 15), 4000)),
)
_filter(
    "filter_attr_contains",
    "json_extract_string(log_attributes, '$.user.role') = 'r0' "
    "AND cast(json_extract(log_attributes, '$.\"http.status_code\"') AS int) = 500 "
    "AND json_extract_string(log_attributes, '$.tags[0]') = 't0'",
    lambda: attributes.contains_text(
        F.col("log_attributes"), {"user": {"role": "r0"}, "http.status_code": 500, "tags": ["t0"]}
    ),
)
_filter(
    "filter_resource_contains",
    "json_extract_string(resource_attributes, '$.\"host.name\"') = 'host-3'",
    lambda: attributes.contains_text(F.col("resource_attributes"), {"host.name": "host-3"}),
)
_filter(
    "filter_attr_path",
    "json_extract_string(log_attributes, '$.user.role') = 'r0'",
    lambda: attributes.attr_text(_attrs(), ["user", "role"]) == "r0",
)
_filter(
    "filter_attr_exists",
    "list_contains(json_keys(log_attributes), 'note')",
    lambda: attributes.has_key(_attrs(), "note"),
)
_filter(
    "filter_errors_subset",
    f"severity = 'error' AND service_name = 'svc-3' AND {BETWEEN}",
    lambda: (F.col("severity") == "error") & (F.col("service_name") == "svc-3")
    & search.in_time_range(START, END),
)
_filter(
    "filter_trace_null", "trace_id IS NULL AND service_name = 'svc-3'",
    lambda: F.col("trace_id").isNull() & (F.col("service_name") == "svc-3"),
)
_filter(
    "filter_recent_received", "received_at > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 600 MINUTE",
    lambda: reports.received_since(times.ntz(AS_OF), 600),
)
_filter(
    "filter_local_time", "\"timestamp\" > TIMESTAMP '2024-01-20 05:00:00'",
    lambda: F.col("timestamp") > times.local_as_utc("2024-01-20 00:00:00", "America/New_York"),
)


@query(
    "filter_trace_lookup",
    oracle.logs(
        f"""SELECT {COLS} FROM logs WHERE trace_id IN (
          SELECT trace_id FROM logs WHERE severity = 'fatal' AND trace_id IS NOT NULL)"""
    ),
)
def filter_trace_lookup(spark, sf_dir):
    """All rows of every trace that has a fatal row."""
    logs = tables.event_logs(spark, sf_dir).select(*LOG_COLUMNS)
    wanted = logs.where((F.col("severity") == "fatal") & F.col("trace_id").isNotNull()).select("trace_id").distinct()
    return logs.where(F.col("trace_id").isNotNull()).join(wanted, "trace_id", "left_semi").select(*LOG_COLUMNS)


@query(
    "promote_attr_column",
    oracle.logs(
        f"""SELECT {COLS}, json_extract_string(log_attributes, '$.user_id') AS user_attr,
          json_extract_string(log_attributes, '$.user.role') AS user_role
          FROM logs WHERE json_extract_string(log_attributes, '$.user.role') = 'r0'"""
    ),
)
def promote_attr_column(spark, sf_dir):
    """Write hot attributes as columns of their own, then filter on one of them."""
    path = scratch_path(spark, "promoted")
    rows = tables.event_logs(spark, sf_dir).select(*LOG_COLUMNS)
    attrs = _attrs()
    rows.withColumns(
        {
            "user_attr": attributes.attr_text(attrs, "user_id"),
            "user_role": attributes.attr_text(attrs, ["user", "role"]),
        }
    ).write.parquet(path)
    return spark.read.parquet(path).where(F.col("user_role") == "r0")


@query(
    "filter_keyword",
    oracle.docs(
        """SELECT id, service_name FROM docs
          WHERE list_has_any(words, ['license', 'licenses', 'licensed', 'licensing'])"""
    ),
)
def filter_keyword(spark, sf_dir):
    """English search: the stop word drops out, every form of the other word is found."""
    logs = tables.document_logs(spark, sf_dir)
    return logs.where(text.matches(F.col("body"), "the Licenses")).select("id", "service_name")


@query("filter_keyword_simple", oracle.docs("SELECT id, service_name FROM docs WHERE list_contains(words, 'the') AND list_contains(words, 'of')"))
def filter_keyword_simple(spark, sf_dir):
    logs = tables.document_logs(spark, sf_dir)
    return logs.where(text.matches(F.col("body"), "The of", "simple")).select("id", "service_name")


@query(
    "page_logs",
    oracle.logs(
        f"""SELECT {COLS} FROM logs WHERE {BETWEEN} AND service_name = 'svc-0' AND severity = 'error'
          ORDER BY "timestamp", id LIMIT 50"""
    ),
)
def page_logs(spark, sf_dir):
    q = search.LogQuery(START, END, service_name="svc-0", level="error", limit=50)
    return search.page(tables.event_logs(spark, sf_dir), q)


@query(
    "page_logs_cursor",
    oracle.logs(
        f"""SELECT {COLS} FROM (SELECT * REPLACE (date_trunc('hour', "timestamp") AS "timestamp") FROM logs)
          WHERE {BETWEEN} AND ("timestamp", id) > (TIMESTAMP '2024-01-11 08:00:00', 3450)
          ORDER BY "timestamp", id LIMIT 100"""
    ),
)
def page_logs_cursor(spark, sf_dir):
    """A later page of rows with many equal timestamps; the id breaks ties."""
    logs = tables.event_logs(spark, sf_dir).withColumn(
        "timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz")
    )
    token = cursors.encode(Cursor(dt.datetime(2024, 1, 11, 8), 3450))
    return search.page(logs, search.LogQuery(START, END, cursor=token))


_TOKEN = (
    "rtrim(translate(to_base64(encode('{\"ts\":\"' || rtrim(rtrim(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '0'), '.') "
    "|| 'Z\",\"id\":' || id || '}')), '+/', '-_'), '=')"
)


@query(
    "page_next_cursor",
    oracle.logs(
        f"""SELECT count(*) AS rows, CASE WHEN count(*) = 50 THEN max(token) END AS next_cursor FROM (
          SELECT last_value({_TOKEN}) OVER (ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
            AS token FROM (SELECT "timestamp" AS ts, id FROM logs WHERE {BETWEEN} ORDER BY 1, 2 LIMIT 50))"""
    ),
)
def page_next_cursor(spark, sf_dir):
    q = search.LogQuery(START, END, limit=50)
    return search.next_cursor(search.page(tables.event_logs(spark, sf_dir), q), q.limit)


@query("cursor_codec", f"SELECT id, ts AS \"timestamp\", {_TOKEN} AS token, ts AS back_ts, id AS back_id FROM (SELECT event_id AS id, ts FROM events)")
def cursor_codec(spark, sf_dir):
    rows = tables.event_logs(spark, sf_dir).select(
        "id", "timestamp", cursors.encode_column(F.col("timestamp"), F.col("id")).alias("token")
    )
    back = cursors.decode_column(F.col("token"))
    return rows.select("*", back["timestamp"].alias("back_ts"), back["id"].alias("back_id"))


@query(
    "page_index",
    oracle.logs(
        f"""SELECT page_no, count(*) AS rows, CASE WHEN count(*) = 64 THEN arg_max(token, pos) END AS next_cursor FROM (
          SELECT pos, pos // 64 + 1 AS page_no, {_TOKEN} AS token FROM (
            SELECT id, ts, row_number() OVER (ORDER BY ts, id) - 1 AS pos FROM (
              SELECT id, date_trunc('hour', "timestamp") AS ts FROM logs)))
          GROUP BY page_no"""
    ),
)
def page_index(spark, sf_dir):
    logs = tables.event_logs(spark, sf_dir)
    tied = logs.withColumn("timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    return search.page_index(tied, 64)


@query(
    "page_numbers",
    oracle.logs(
        """SELECT id, "timestamp", (row_number() OVER (ORDER BY "timestamp", id) - 1) // 1000 + 1 AS page_no FROM logs"""
    ),
)
def page_numbers(spark, sf_dir):
    return search.page_numbers(tables.event_logs(spark, sf_dir).select("id", "timestamp"), 1000)


@query("latest_first", oracle.logs(f"SELECT {COLS} FROM logs ORDER BY \"timestamp\" DESC, id DESC LIMIT 100"))
def latest_first(spark, sf_dir):
    return search.latest(tables.event_logs(spark, sf_dir), 100)


@query(
    "preset_window_filter",
    oracle.logs(
        f"""SELECT {COLS} FROM logs WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 6 HOUR
          AND TIMESTAMP '2024-01-30 12:00:00'"""
    ),
)
def preset_window_filter(spark, sf_dir):
    start, end = times.preset_window(dt.datetime(2024, 1, 30, 12), "6h")
    return tables.event_logs(spark, sf_dir).where(search.in_time_range(start, end)).select(*LOG_COLUMNS)


@query(
    "validate_query_params",
    """SELECT event_id AS query_id, CASE
        WHEN event_id % 19 = 0 THEN 'start_time and end_time are required'
        WHEN event_id % 17 = 0 THEN 'start_time: must be RFC3339 format'
        WHEN event_id % 13 = 0 THEN 'end_time: must be RFC3339 format'
        WHEN event_id % 9 - 1 < 0 THEN 'end_time must be after start_time'
        WHEN event_id % 9 - 1 > 7 OR (event_id % 9 - 1 = 7 AND event_id % 2 = 1) THEN 'time range must not exceed 7 days'
        WHEN event_type NOT IN ('error', 'signup') THEN 'level: must be one of debug, info, warn, error, fatal'
        WHEN event_id % 23 = 0 THEN 'keyword: must not exceed 256 characters'
        WHEN event_id % 29 = 0 THEN 'cursor: invalid cursor'
        WHEN event_id % 31 = 0 OR event_id % 5 IN (0, 1, 2) THEN 'limit: must be an integer between 1 and 1000'
      END AS error FROM events""",
)
def validate_query_params(spark, sf_dir):
    """Every event as a saved query, with one fault of each kind among them."""
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    saved = tables.table(spark, sf_dir, "events").selectExpr(
        "event_id as query_id",
        f"case when event_id % 19 = 0 then null when event_id % 17 = 0 then 'yesterday' "
        f"else date_format(ts, \"{fmt}\") || 'Z' end as start_time",
        f"case when event_id % 13 = 0 then '2024-01-01 00:00:00' else date_format(ts + make_dt_interval("
        f"cast(event_id % 9 - 1 as int), 0, 0, event_id % 2), \"{fmt}\") || 'Z' end as end_time",
        "case event_type when 'signup' then 'warn' when 'click' then 'ERROR' else event_type end as level",
        "case when event_id % 23 = 0 then repeat('é', 129) else 'timeout' end as keyword",
        "case when event_id % 29 = 0 then 'not*a*cursor' when event_id % 3 = 0 then '' "
        "else 'eyJ0cyI6IjIwMjQtMDEtMDFUMDA6MDA6MDBaIiwiaWQiOjF9' end as cursor",
        "case when event_id % 31 = 0 then ' 10 ' when event_id % 5 = 0 then '0' when event_id % 5 = 1 then '1001' "
        "when event_id % 5 = 2 then 'ten' when event_id % 5 = 3 then '' else '1000' end as `limit`",
    )
    return search.check_saved_queries(saved)


@query(
    "build_term_index",
    oracle.docs(
        'SELECT DISTINCT unnest(words) AS term, cast("timestamp" AS date) AS event_date, id FROM docs'
    ),
)
def build_term_index(spark, sf_dir):
    """Write the inverted index of all documents and read it back."""
    path = scratch_path(spark, "terms")
    terms.write_term_index(terms.term_index(tables.document_logs(spark, sf_dir), "simple"), path)
    return spark.read.schema("term string, id bigint, event_date date").parquet(path)


@query(
    "term_index_search",
    oracle.docs("SELECT id FROM docs WHERE list_contains(words, 'the') AND list_contains(words, 'of')"),
)
def term_index_search(spark, sf_dir):
    """Search through the written index."""
    path = scratch_path(spark, "terms")
    terms.write_term_index(terms.term_index(tables.document_logs(spark, sf_dir), "simple"), path)
    index = spark.read.schema("term string, id bigint, event_date date").parquet(path)
    return terms.matching_ids(index, "the of", "simple")


WEEK = search.LogQuery(dt.datetime(2024, 1, 1, 0, 30), dt.datetime(2024, 1, 7, 12), keyword="the Licenses")


@query(
    "stored_keyword_search",
    oracle.docs(
        """SELECT id, service_name FROM docs
          WHERE list_has_any(words, ['license', 'licenses', 'licensed', 'licensing'])
            AND "timestamp" BETWEEN TIMESTAMP '2024-01-01 00:30:00' AND TIMESTAMP '2024-01-07 12:00:00'"""
    ),
)
def stored_keyword_search(spark, sf_dir):
    """English search of a week in a stored table: two loads with an index, one load without, one day compacted."""
    path = scratch_path(spark, "indexed-logs")
    docs = tables.document_logs(spark, sf_dir)
    kinds = {"timestamp": "timestamp_ntz", "received_at": "timestamp_ntz"}
    logs = docs.select(*[
        F.col(c) if c in docs.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in LOG_COLUMNS
    ])
    for load in range(3):
        part = logs.where(F.pmod("id", F.lit(3)) == load)
        sinks.append_logs(part, path, f"load-{load}", index="english" if load else None)
    sinks.compact_day(spark, path, "2024-01-02", "packed")
    return stored.matching(spark, path, WEEK).select("id", "service_name")
