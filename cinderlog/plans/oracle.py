"""DuckDB forms of the table views, as common table expressions."""

from __future__ import annotations

from cinderlog.sources import tables as t

K = "json_extract_string(props, '$.k')"
TS_TEXT = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"

LOGS = f"""logs AS (
  SELECT event_id AS id, ts AS "timestamp", ts + to_seconds(event_id % 30) AS received_at,
    {t.SERVICE} AS service_name, {t.SEVERITY} AS severity, event_type AS severity_text, {t.BODY} AS body,
    CASE WHEN event_id % 10 = 0 THEN NULL
         ELSE md5(cast(user_id AS varchar) || '-' || strftime(ts, '%Y%m%d%H')) END AS trace_id,
    {t.SPAN_ID} AS span_id, {t.RESOURCE_ATTRIBUTES} AS resource_attributes,
    {t.LOG_ATTRIBUTES.format(k=K)} AS log_attributes,
    CASE WHEN event_id % 4 = 0 THEN '{t.SCHEMA_URL}' END AS schema_url,
    cast(ts AS date) AS event_date
  FROM events)"""

DOCS = """docs AS (
  SELECT doc_id AS id, text AS body, source AS service_name,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id % 20160) AS "timestamp",
    regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+') AS words
  FROM documents)"""

SENT = f"""sent AS (
  SELECT event_id, ts, user_id, {t.BATCH_ID} AS batch_id, {t.sent_event(TS_TEXT, K)} AS e,
    CASE WHEN event_id % 971 = 17 THEN NULL ELSE ts END AS "timestamp",
    {t.SENT['severity']} AS severity, {t.SENT['service']} AS service_name, {t.SENT['body']} AS body,
    {t.SENT['span']} AS span_id, event_id % 967 = 19 AS many_keys,
    CASE WHEN event_id % 967 = 19 THEN '{t.MANY_KEYS}' ELSE {t.LOG_ATTRIBUTES.format(k=K)} END AS log_attributes
  FROM events),
batches AS (
  SELECT batch_id, count(*) AS n, string_agg(e, ',' ORDER BY event_id) AS joined FROM sent GROUP BY batch_id),
texts AS (
  SELECT batch_id, n, {t.PAYLOAD.format(e='joined')} AS payload,
    CASE WHEN batch_id % 41 = 40 OR batch_id % 43 = 42 THEN 'invalid-json' END AS broken,
    batch_id % 47 = 45 OR batch_id % 53 = 12 AS hollow
  FROM batches),
placed AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.batch_id ORDER BY event_id) - 1 AS event_index
  FROM sent s JOIN texts USING (batch_id) WHERE broken IS NULL AND NOT hollow)"""

# Violations in the order the batch check reports them.
FOUND = """found AS (
  SELECT batch_id, -1 AS event_index, 0 AS place, 'events' AS field, 'must contain at least one event' AS message
  FROM texts WHERE broken IS NULL AND hollow
  UNION ALL
  SELECT batch_id, -1, 0, 'events', 'batch size ' || n || ' exceeds maximum of 1000'
  FROM texts WHERE broken IS NULL AND NOT hollow AND n > 1000
  UNION ALL
  SELECT batch_id, event_index, place, 'events[' || event_index || '].' || field, message FROM (
    SELECT batch_id, event_index, 1 AS place, 'timestamp' AS field,
      'required; must be a valid RFC3339 timestamp' AS message FROM placed WHERE "timestamp" IS NULL
    UNION ALL
    SELECT batch_id, event_index, 2, 'severity', 'must be one of: debug, info, warn, error, fatal'
    FROM placed WHERE severity NOT IN ('debug', 'info', 'warn', 'error', 'fatal')
    UNION ALL
    SELECT batch_id, event_index, 3, 'body', 'required; must be non-empty' FROM placed WHERE body = ''
    UNION ALL
    SELECT batch_id, event_index, 3, 'body', 'must not exceed 32,768 characters'
    FROM placed WHERE octet_length(encode(body)) > 32768
    UNION ALL
    SELECT batch_id, event_index, 4, 'service_name', 'required; must be non-empty' FROM placed WHERE service_name = ''
    UNION ALL
    SELECT batch_id, event_index, 4, 'service_name', 'must not exceed 255 characters'
    FROM placed WHERE octet_length(encode(service_name)) > 255
    UNION ALL
    SELECT batch_id, event_index, 5, 'log_attributes', 'must not contain more than 100 keys'
    FROM placed WHERE many_keys)),
verdicts AS (
  SELECT batch_id, coalesce(broken, CASE WHEN v.n IS NOT NULL THEN 'validation-failed' END) AS problem,
    CASE WHEN broken IS NOT NULL OR hollow THEN 0 ELSE texts.n END AS n_events, coalesce(v.n, 0) AS n_violations
  FROM texts LEFT JOIN (SELECT batch_id, count(*) AS n FROM found GROUP BY batch_id) v USING (batch_id)),
accepted AS (SELECT p.* FROM placed p JOIN verdicts USING (batch_id) WHERE problem IS NULL)"""


def logs(sql: str) -> str:
    return f"WITH {LOGS}\n{sql}"


def docs(sql: str) -> str:
    return f"WITH {DOCS}\n{sql}"


def sent(sql: str) -> str:
    return f"WITH {SENT}\n{sql}"


def checked(sql: str) -> str:
    return f"WITH {SENT},\n{FOUND}\n{sql}"
