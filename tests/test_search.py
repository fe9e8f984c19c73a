"""Search parameters, cursors, pages and plans."""

import contextlib
import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

from cinderlog.fixed import LOG_COLUMNS
from cinderlog.functions import cursors, times
from cinderlog.functions.cursors import Cursor
from cinderlog.operators import search, sinks
from cinderlog.operators.search import LogQuery
from cinderlog.sources import tables

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "bad, message",
    [
        ({"start": None}, "required"),
        ({"end": T0 - dt.timedelta(seconds=1)}, "after start_time"),
        ({"end": T0 + dt.timedelta(days=8)}, "exceed 7 days"),
        ({"level": "VERBOSE"}, "level"),
        ({"keyword": "é" * 129}, "keyword"),
        ({"cursor": "not*base64"}, "invalid cursor"),
        ({"cursor": "e30"}, "invalid cursor"),
        ({"limit": 0}, "limit"),
        ({"limit": 1001}, "limit"),
        ({"limit": "ten"}, "limit"),
    ],
)
def test_bad_parameters(bad, message):
    with pytest.raises(ValueError, match=message):
        LogQuery(**{"start": T0, "end": T0 + dt.timedelta(days=1), **bad})


def test_edges_are_allowed():
    assert LogQuery(T0, T0).limit == 100
    LogQuery(T0, T0 + dt.timedelta(days=7), keyword="é" * 128, limit=1000)


@pytest.mark.parametrize("micros", [0, 1, 120000, 999999])
def test_cursor_round_trip(spark, micros):
    c = Cursor(T0.replace(microsecond=micros), 2**62)
    token = cursors.encode(c)
    assert "=" not in token and cursors.decode(token) == c
    row = spark.range(1).select(
        cursors.encode_column(times.ntz(c.timestamp), F.lit(c.id)).alias("t"),
        cursors.decode_column(F.lit(token)).alias("c"),
        cursors.decode_column(F.lit("??")).alias("bad"),
        cursors.decode_column(F.lit("____")).alias("bytes"),
        cursors.decode_column(F.lit("e30")).alias("empty"),
    ).first()
    assert row["t"] == token and tuple(row["c"]) == (c.timestamp, c.id)
    assert row["bad"] is None and row["bytes"] is None and row["empty"] is None


def logs(spark, rows):
    full = [(i, ts, ts, "svc", "info", None, body, None, None, None, None, None) for i, ts, body in rows]
    ddl = (
        "id bigint, timestamp timestamp_ntz, received_at timestamp_ntz, service_name string, severity string, "
        "severity_text string, body string, trace_id string, span_id string, resource_attributes string, "
        "log_attributes string, schema_url string"
    )
    return spark.createDataFrame(full, ddl)


def test_pages_cover_everything_once(spark):
    rows = [(i, T0 + dt.timedelta(milliseconds=i // 3), f"event {i}") for i in range(20)]
    frame = logs(spark, rows)
    for lookahead, pages in ((False, 5), (True, 4)):
        seen, cursor, n = [], None, 0
        while True:
            page, cursor = search.fetch(frame, LogQuery(T0, T0 + dt.timedelta(hours=1), limit=5, cursor=cursor), lookahead)
            seen += [r["id"] for r in page]
            n += 1
            if cursor is None:
                break
        assert seen == list(range(20)) and n == pages


def test_empty_result(spark):
    frame = logs(spark, [(1, T0, "x")])
    late = T0 + dt.timedelta(days=1)
    assert search.fetch(frame, LogQuery(late, late)) == ([], None)


def test_injection_text_is_a_value(spark):
    q = LogQuery(T0, T0, service_name="x' OR '1'='1")
    assert search.page(logs(spark, [(1, T0, "x")]), q).count() == 0


@pytest.mark.parametrize(
    "keyword, hit",
    [("xylophone", True), ("Xylophones failing", False), ("failures cascading", True), ("the", False), ("e2e-12", False)],
)
def test_keyword(spark, keyword, hit):
    frame = logs(spark, [(1, T0, "xylophone cascade failure")])
    assert bool(search.fetch(frame, LogQuery(T0, T0, keyword=keyword))[0]) == hit


def test_hyphenated_marker_is_found(spark):
    frame = logs(spark, [(1, T0, "planted line canary-lot-4471"), (2, T0, "planted line canary-lot-4472")])
    page, _ = search.fetch(frame, LogQuery(T0, T0, keyword="canary-lot-4471"))
    assert [r["id"] for r in page] == [1]


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_plan_of_a_page(spark, tmp_path, sf_dir):
    source = tables.event_logs(spark, sf_dir).select(*LOG_COLUMNS)
    sinks.append_logs(source, str(tmp_path / "t"), "a", with_terms=False)
    table = sinks.read_logs(spark, str(tmp_path / "t"))
    q = LogQuery(dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 4), service_name="svc-3", level="error",
                 cursor=Cursor(dt.datetime(2024, 1, 3, 1), 7))
    text = plan(search.page(table, q))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    # Day bounds begin at the cursor, and only finished loads are read.
    pruned = next(line for line in text.splitlines() if line.startswith("PartitionFilters"))
    assert "isnotnull(event_date" in pruned and "event_date#" in pruned and "load#" in pruned
    for pushed in ("EqualTo(service_name,svc-3)", "EqualTo(severity,error)", "GreaterThanOrEqual(timestamp"):
        assert pushed in text
    from cinderlog.functions import attributes

    hit = table.where(attributes.contains(F.col("log_attributes"), {"user": {"role": "r0"}})).select("id")
    text = plan(hit)
    assert "EqualTo(log_attributes" in text, text  # the shredded field is filtered in the scan


def test_preset_and_local_time(spark):
    assert times.preset_window(T0) == (T0 - dt.timedelta(hours=1), T0)
    utc = spark.range(1).select(times.local_as_utc("2024-07-01 00:00:00", "America/New_York")).first()[0]
    assert utc == dt.datetime(2024, 7, 1, 4)


def test_response_objects_leave_empty_fields_out(spark):
    import json

    row = search.response_json(logs(spark, [(1, T0, "x")])).first()
    assert json.loads(row["event"]) == {
        "id": "1", "timestamp": "2024-01-01T00:00:00Z", "received_at": "2024-01-01T00:00:00Z",
        "service_name": "svc", "severity": "info", "body": "x",
    }


@pytest.mark.parametrize(
    "changes, message",
    [
        ({"start_time": ""}, "required"),
        ({"start_time": "2024-01-01"}, "start_time: must be RFC3339"),
        ({"end_time": "2024-13-01T00:00:00Z"}, "end_time: must be RFC3339"),
        ({"end_time": "2023-12-31T00:00:00Z"}, "after start_time"),
        ({"end_time": "2024-01-08T00:00:00.000001Z"}, "exceed 7 days"),
        ({"limit": "ten"}, "limit"),
        ({"limit": "9999"}, "limit"),
        ({"level": "Error"}, "level"),
    ],
)
def test_text_parameters(changes, message):
    good = {"start_time": "2024-01-01T01:00:00+01:00", "end_time": "2024-01-08T00:00:00Z", "limit": "", "level": ""}
    q = search.query_from_text(good)
    assert (q.start, q.limit, q.level) == (T0, 100, None)
    with pytest.raises(ValueError, match=message):
        search.query_from_text({**good, **changes})
