"""Log search: checked parameters, filters, one ordered page and its cursor."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cinderlog import fixed
from cinderlog.functions import cursors, severity, text
from cinderlog.functions.cursors import Cursor
from cinderlog.functions.times import ntz, parse_rfc3339
from cinderlog.operators import ranks


@dataclass(frozen=True)
class LogQuery:
    """Parameters of one search. Times are inclusive on both ends."""

    start: dt.datetime
    end: dt.datetime
    service_name: str | None = None
    level: str | None = None
    keyword: str | None = None
    cursor: Cursor | str | None = None
    limit: int = fixed.DEFAULT_PAGE
    max_range_days: int = fixed.MAX_RANGE_DAYS

    def __post_init__(self):
        if self.start is None or self.end is None:
            raise ValueError(fixed.ERR_TIMES_REQUIRED)
        if self.end < self.start:
            raise ValueError(fixed.ERR_ORDER)
        if self.end - self.start > dt.timedelta(days=self.max_range_days):
            raise ValueError(fixed.ERR_RANGE % self.max_range_days)
        if self.level and self.level not in fixed.SEVERITIES:
            raise ValueError(fixed.ERR_LEVEL)
        if self.keyword and len(self.keyword.encode()) > fixed.MAX_KEYWORD_BYTES:
            raise ValueError(fixed.ERR_KEYWORD)
        if isinstance(self.limit, bool) or not isinstance(self.limit, int) or not 1 <= self.limit <= fixed.MAX_PAGE:
            raise ValueError(fixed.ERR_LIMIT)
        if isinstance(self.cursor, str):
            object.__setattr__(self, "cursor", cursors.decode(self.cursor) if self.cursor else None)


def query_from_text(params: Mapping[str, str], max_range_days: int = fixed.MAX_RANGE_DAYS) -> LogQuery:
    """A query from text parameters, as a client sends them; empty ones count as absent."""
    given = {k: v for k, v in params.items() if v}
    if "start_time" not in given or "end_time" not in given:
        raise ValueError(fixed.ERR_TIMES_REQUIRED)
    limit = given.get("limit", str(fixed.DEFAULT_PAGE))
    return LogQuery(
        start=_utc(given["start_time"], fixed.ERR_START_FORMAT),
        end=_utc(given["end_time"], fixed.ERR_END_FORMAT),
        service_name=given.get("service_name"),
        level=given.get("level"),
        keyword=given.get("keyword"),
        cursor=given.get("cursor"),
        limit=int(limit) if re.fullmatch(r"[+-]?[0-9]+", limit) else 0,
        max_range_days=max_range_days,
    )


def _utc(text: str, error: str) -> dt.datetime:
    try:
        if not re.match(fixed.RFC3339, text):
            raise ValueError(text)
        return dt.datetime.fromisoformat(text).astimezone(dt.timezone.utc).replace(tzinfo=None)
    except ValueError as e:
        raise ValueError(error) from e


def in_time_range(start, end, ts: str = "timestamp") -> Column:
    return (F.col(ts) >= ntz(start)) & (F.col(ts) <= ntz(end))


def in_days(start, end, day: str = "event_date") -> Column:
    """Day bounds of a time range; Parquet partitions are pruned only by these."""
    return (F.col(day) >= F.to_date(ntz(start))) & (F.col(day) <= F.to_date(ntz(end)))


def after_cursor(cursor: Cursor, ts: str = "timestamp", row_id: str = "id") -> Column:
    """Rows behind the cursor. The leading bound alone can be pushed to the scan."""
    at = ntz(cursor.timestamp)
    return (F.col(ts) >= at) & ((F.col(ts) > at) | (F.col(row_id) > cursor.id))


def filtered(logs: DataFrame, q: LogQuery) -> DataFrame:
    """All filters of a query, day bounds included when the table is partitioned by day."""
    rows = logs.where(in_time_range(q.start, q.end))
    if "event_date" in logs.columns:
        rows = rows.where(in_days(max(q.start, q.cursor.timestamp) if q.cursor else q.start, q.end))
    if q.service_name:
        rows = rows.where(F.col("service_name") == q.service_name)
    if q.level:
        rows = rows.where(F.col("severity") == q.level)
    if q.cursor:
        rows = rows.where(after_cursor(q.cursor))
    if q.keyword:
        if "body_terms" in logs.columns:
            rows = rows.where(text.matches_terms(F.col("body_terms"), q.keyword))
        else:
            rows = rows.where(text.matches(F.col("body"), q.keyword))
    return rows


def page(logs: DataFrame, q: LogQuery) -> DataFrame:
    """One page in (timestamp, id) order; runs as a distributed top-k."""
    return filtered(logs, q).orderBy("timestamp", "id").limit(q.limit).select(*fixed.LOG_COLUMNS)


def latest(logs: DataFrame, limit: int, since=None) -> DataFrame:
    """The newest rows; with ``since`` only days from then on are read."""
    if since is not None:
        logs = logs.where(F.col("timestamp") >= ntz(since))
        if "event_date" in logs.columns:
            logs = logs.where(F.col("event_date") >= F.to_date(ntz(since)))
    return logs.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit).select(*fixed.LOG_COLUMNS)


def trace_lookup(logs: DataFrame, trace_id: str, span_id: str | None = None, start=None, end=None) -> DataFrame:
    """All rows of a trace, or of one of its spans; times bound the days that are read."""
    rows = logs.where(F.col("trace_id") == trace_id)
    if span_id is not None:
        rows = rows.where(F.col("span_id") == span_id)
    if start is not None and end is not None:
        rows = rows.where(in_time_range(start, end))
        if "event_date" in logs.columns:
            rows = rows.where(in_days(start, end))
    return rows.select(*fixed.LOG_COLUMNS)


def next_cursor(page_rows: DataFrame, limit: int) -> DataFrame:
    """Cursor of a page's last row if the page is full, else NULL.

    A result whose size is a multiple of the limit therefore ends with one
    empty page.
    """
    last = F.max(F.struct("timestamp", "id")).alias("last")
    return page_rows.agg(F.count(F.lit(1)).alias("rows"), last).select(
        "rows",
        F.when(F.col("rows") == limit, cursors.encode_column(F.col("last.timestamp"), F.col("last.id"))).alias(
            "next_cursor"
        ),
    )


def fetch(logs: DataFrame, q: LogQuery, lookahead: bool = False) -> tuple[list, str | None]:
    """Rows of one page and the cursor to continue from.

    With ``lookahead`` one row more is read, so that the cursor is None exactly
    when nothing follows.
    """
    extra = 1 if lookahead else 0
    ordered = filtered(logs, q).orderBy("timestamp", "id").limit(q.limit + extra).select(*fixed.LOG_COLUMNS)
    rows = ordered.collect()  # at most one page
    more = len(rows) > q.limit if lookahead else len(rows) == q.limit
    rows = rows[: q.limit]
    if not more:
        return rows, None
    return rows, cursors.encode(Cursor(rows[-1]["timestamp"], rows[-1]["id"]))


def page_numbers(rows: DataFrame, limit: int, slices: int | None = None) -> DataFrame:
    """Page number of every row of a whole result, counted from 1."""
    placed = ranks.positions(rows, [], ["timestamp", "id"], "_pos", slices)
    return placed.withColumn("page_no", (F.expr(f"_pos div {int(limit)}") + 1).cast("bigint")).drop("_pos")


def page_index(rows: DataFrame, limit: int, slices: int | None = None) -> DataFrame:
    """One row per page of a whole result: size and the cursor to the next page."""
    numbered = page_numbers(rows.select("timestamp", "id"), limit, slices)
    pages = numbered.groupBy("page_no").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.struct("timestamp", "id")).alias("last")
    )
    token = cursors.encode_column(F.col("last.timestamp"), F.col("last.id"))
    return pages.select("page_no", "rows", F.when(F.col("rows") == limit, token).alias("next_cursor"))


def read_back(rows: DataFrame) -> DataFrame:
    """Search output form: text id, empty text for absent fields, attributes as JSON."""
    shown = {c: F.coalesce(F.col(c), F.lit("")) for c in ("severity_text", "trace_id", "span_id", "schema_url")}
    shown["id"] = F.col("id").cast("string")
    for c in ("resource_attributes", "log_attributes"):
        if dict(rows.dtypes)[c] == "variant":
            shown[c] = F.to_json(c)
    return rows.withColumns(shown).select(*fixed.LOG_COLUMNS)


def response_json(rows: DataFrame) -> DataFrame:
    """Each row as the JSON object a client receives; empty optional fields are left out."""
    kinds = dict(rows.dtypes)

    def attributes(c):
        return F.try_parse_json(c) if kinds[c] == "string" else F.col(c)

    from cinderlog.functions.times import format_rfc3339

    optional = {c: F.nullif(F.col(c), F.lit("")) for c in ("severity_text", "trace_id", "span_id", "schema_url")}
    values = {
        **{c: F.col(c) for c in fixed.LOG_COLUMNS},
        **optional,
        "id": F.col("id").cast("string"),
        "timestamp": format_rfc3339(F.col("timestamp")),
        "received_at": format_rfc3339(F.col("received_at")),
        "resource_attributes": attributes("resource_attributes"),
        "log_attributes": attributes("log_attributes"),
    }
    return rows.select("id", F.to_json(F.struct(*[v.alias(k) for k, v in values.items()])).alias("event"))


def check_saved_queries(saved: DataFrame, max_range_days: int = fixed.MAX_RANGE_DAYS) -> DataFrame:
    """First problem of each saved query; NULL where its parameters are fine.

    Columns: query_id, start_time, end_time, level, keyword, cursor, limit, all text.
    """
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in saved.columns if c != "query_id"}
    start, end = parse_rfc3339(blank["start_time"]), parse_rfc3339(blank["end_time"])
    span = F.unix_micros(end) - F.unix_micros(start)
    limit = F.when(F.col("limit").rlike(r"^[+-]?[0-9]+\z"), F.expr("try_cast(`limit` as int)"))
    error = (
        F.when((blank["start_time"] == "") | (blank["end_time"] == ""), F.lit(fixed.ERR_TIMES_REQUIRED))
        .when(start.isNull(), F.lit(fixed.ERR_START_FORMAT))
        .when(end.isNull(), F.lit(fixed.ERR_END_FORMAT))
        .when(span < 0, F.lit(fixed.ERR_ORDER))
        .when(span > max_range_days * 86400 * 1_000_000, F.lit(fixed.ERR_RANGE % max_range_days))
        .when((blank["level"] != "") & ~severity.is_known(blank["level"]), F.lit(fixed.ERR_LEVEL))
        .when(F.octet_length(blank["keyword"]) > fixed.MAX_KEYWORD_BYTES, F.lit(fixed.ERR_KEYWORD))
        .when(
            (blank["cursor"] != "") & cursors.decode_column(blank["cursor"]).isNull(),
            F.lit(fixed.ERR_CURSOR),
        )
        .when(
            (blank["limit"] != "") & ~F.coalesce(limit.between(1, fixed.MAX_PAGE), F.lit(False)),
            F.lit(fixed.ERR_LIMIT),
        )
    )
    return saved.select("query_id", error.alias("error"))
