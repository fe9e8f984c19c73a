"""Trace and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderlog.operators import metrics, traces
from cinderlog.plans import oracle
from cinderlog.plans.registry import query
from cinderlog.sources import tables


@query(
    "correlate_logs_spans",
    oracle.logs("""SELECT id, trace_id, span_id, body,
        CASE WHEN trace_id IS NOT NULL AND severity <> 'debug' THEN severity_text END AS span_operation_name,
        CASE WHEN trace_id IS NOT NULL AND severity <> 'debug' THEN "timestamp" END AS span_start_time FROM logs"""),
)
def correlate_logs_spans(spark, sf_dir):
    logs = tables.event_logs(spark, sf_dir).select("id", "trace_id", "span_id", "body")
    return traces.correlate(logs, tables.log_spans(spark, sf_dir))


_SPANS = f"""SELECT event_id, event_id - event_id % 64 AS block,
    md5('t' || cast(event_id // 64 AS varchar)) AS trace_id, {tables.SPAN_ID} AS span_id,
    CASE WHEN event_id % 64 = 0 THEN '' WHEN event_id % 64 = 50 THEN 'missing'
      ELSE substr(md5(cast(event_id - event_id % 64 + (event_id % 64 - 1) // 3 AS varchar)), 1, 16) END AS parent_span_id
  FROM events"""


@query(
    "trace_tree",
    f"""WITH RECURSIVE spans AS ({_SPANS}), sent AS (
        SELECT * FROM spans UNION ALL SELECT * FROM spans WHERE substr(span_id, 1, 1) IN ('3', 'b')), tree AS (
        SELECT trace_id, span_id, span_id AS root_span_id, 0::bigint AS depth FROM spans WHERE parent_span_id = ''
        UNION ALL
        SELECT s.trace_id, s.span_id, t.root_span_id, t.depth + 1 FROM spans s
        JOIN tree t ON s.trace_id = t.trace_id AND s.parent_span_id = t.span_id)
      SELECT s.trace_id, s.span_id, s.parent_span_id, t.root_span_id, t.depth
      FROM sent s LEFT JOIN tree t USING (trace_id, span_id)""",
)
def trace_tree(spark, sf_dir):
    """Trees of spans of which some were delivered twice."""
    spans = tables.block_spans(spark, sf_dir).select("trace_id", "span_id", "parent_span_id")
    return traces.trace_tree(spans.unionByName(spans.where("substr(span_id, 1, 1) in ('3', 'b')")))


@query(
    "trace_breakdown",
    f"""SELECT trace_id, service_name, count(*) AS spans, count(*) FILTER (WHERE event_type = 'error') AS error_spans,
        cast(sum(us) AS bigint) AS service_us, any_value(trace_us) AS trace_us, any_value(trace_spans) AS trace_spans
      FROM (SELECT *, max(e) OVER (PARTITION BY trace_id) - min(s) OVER (PARTITION BY trace_id) AS trace_us,
          count(*) OVER (PARTITION BY trace_id) AS trace_spans
        FROM (SELECT event_type, md5('t' || cast(event_id // 64 AS varchar)) AS trace_id, {tables.SERVICE} AS service_name,
            epoch_us(ts) AS s, cast(round(value * 1e6) AS bigint) AS us,
            epoch_us(ts) + cast(round(value * 1e6) AS bigint) AS e FROM events))
      GROUP BY trace_id, service_name""",
)
def trace_breakdown(spark, sf_dir):
    return traces.trace_breakdown(tables.block_spans(spark, sf_dir))


@query(
    "metric_rollup",
    """SELECT event_type AS metric_name, w AS window_start, count(*) AS points, round(sum(value), 6) AS sum,
        round(sum(value) / count(*), 6) AS avg, min(value) AS min, max(value) AS max,
        max(value) FILTER (WHERE pos = n * 95 // 100) AS p95, max(value) FILTER (WHERE pos = n * 99 // 100) AS p99
      FROM (SELECT *, row_number() OVER (PARTITION BY event_type, w ORDER BY value) - 1 AS pos,
          count(*) OVER (PARTITION BY event_type, w) AS n
        FROM (SELECT event_type, value, to_timestamp(epoch_us(ts) // 21600000000 * 21600)::timestamp AS w
          FROM events WHERE user_id % 3 <> 1 AND ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-29'))
      GROUP BY event_type, w""",
)
def metric_rollup(spark, sf_dir):
    """Two label values in turn, six-hour steps."""
    points = tables.metric_points(spark, sf_dir)
    chosen = [
        metrics.select_points(points, "2024-01-02", "2024-01-29", labels={"tier": tier}) for tier in ("0", "2")
    ]
    rolled = metrics.metric_rollup(chosen[0].unionByName(chosen[1]), 21600)
    return rolled.withColumns({"sum": F.round("sum", 6), "avg": F.round("avg", 6)})
