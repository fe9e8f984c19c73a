"""Batch checks on small payloads."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from cinderlog import fixed
from cinderlog.operators import ingest
from cinderlog.sources.payloads import inflate

GOOD = {"timestamp": "2024-01-01T00:00:00.5Z", "service_name": "api", "severity": "info", "body": "hello"}


def batch(*events):
    return json.dumps({"events": list(events)})


def event(**changes):
    return {k: v for k, v in {**GOOD, **changes}.items() if v is not ...}


def check(spark, payload, **limits):
    rows = spark.createDataFrame([(1, payload)], "batch_id bigint, payload string")
    checked = ingest.check(ingest.decode(rows, **limits))
    problem = checked.select("problem").first()[0]
    found = [(r["field"], r["message"]) for r in ingest.violations(checked).orderBy("violation_index").collect()]
    return problem, found


@pytest.mark.parametrize(
    "payload, problem, fields",
    [
        (batch(event(), event(), event()), None, []),
        (batch(), "validation-failed", ["events"]),
        ("null", "validation-failed", ["events"]),
        ("{}", "validation-failed", ["events"]),
        (batch(event(severity="VERBOSE")), "validation-failed", ["events[0].severity"]),
        (batch(event(service_name="")), "validation-failed", ["events[0].service_name"]),
        (batch(event(body="")), "validation-failed", ["events[0].body"]),
        (batch(event(body="x" * 32768)), None, []),
        (batch(event(body="x" * 32769)), "validation-failed", ["events[0].body"]),
        (batch(event(body="é" * 16385)), "validation-failed", ["events[0].body"]),
        (batch(event(service_name="s" * 256)), "validation-failed", ["events[0].service_name"]),
        (batch(*[event()] * 1001), "validation-failed", ["events"]),
        (batch(event(log_attributes={f"k{i}": i for i in range(100)})), None, []),
        (batch(event(log_attributes={f"k{i}": i for i in range(101)})), "validation-failed", ["events[0].log_attributes"]),
        (batch(event(severity="x", service_name="")), "validation-failed", ["events[0].severity", "events[0].service_name"]),
        (batch({}), "validation-failed", ["events[0].timestamp", "events[0].severity", "events[0].body", "events[0].service_name"]),
        (batch(None), "validation-failed", ["events[0].timestamp", "events[0].severity", "events[0].body", "events[0].service_name"]),
        (batch(event(timestamp="0001-01-01T00:00:00Z")), "validation-failed", ["events[0].timestamp"]),
        (batch(event(), event(body="")), "validation-failed", ["events[1].body"]),
        (batch(event(extra={"unknown": 1}, id="7", received_at="2024-01-01T00:00:00+02:00")), None, []),
        (batch(event(trace_id=None, log_attributes=None)), None, []),
        ("not json", "invalid-json", []),
        ("", "invalid-json", []),
        ("[]", "invalid-json", []),
        ('{"events":"x"}', "invalid-json", []),
        ('{"events":[5]}', "invalid-json", []),
        (batch(event(body=5)), "invalid-json", []),
        (batch(event(timestamp=5)), "invalid-json", []),
        (batch(event(timestamp="2024-01-01")), "invalid-json", []),
        (batch(event(timestamp="2024-02-30T00:00:00Z")), "invalid-json", []),
        (batch(event(timestamp="")), "invalid-json", []),
        (batch(event(), event(log_attributes=[1])), "invalid-json", []),
        (batch(event(received_at="soon")), "invalid-json", []),
        (batch(event(id=5)), "invalid-json", []),
    ],
)
def test_batch_check(spark, payload, problem, fields):
    got, found = check(spark, payload)
    assert got == problem
    assert [f for f, _ in found] == fields


def test_messages(spark):
    _, found = check(spark, batch(*[event(service_name="", body="")] * 1, {}))
    assert ("events[0].body", "required; must be non-empty") in found
    assert ("events[1].timestamp", "required; must be a valid RFC3339 timestamp") in found
    _, found = check(spark, batch(*[event()] * 1001))
    assert found == [("events", "batch size 1001 exceeds maximum of 1000")]


def test_duplicate_attribute_keys_count_once(spark):
    text = "{" + ",".join(['"k":1'] * 150) + "}"
    payload = batch(event(log_attributes="@")).replace('"@"', text)
    assert check(spark, payload) == (None, [])


def test_size_guard_counts_bytes(spark):
    payload = batch(event(body="é" * 100))
    assert check(spark, payload, max_bytes=len(payload.encode()))[0] is None
    assert check(spark, payload, max_bytes=len(payload.encode()) - 1)[0] == "payload-too-large"


def test_timestamps_are_utc(spark):
    rows = spark.createDataFrame([(1, batch(event(timestamp="2024-01-01T02:00:00.123456789+02:00")))], "batch_id bigint, payload string")
    ts = ingest.decoded_events(ingest.decode(rows)).first()["timestamp"]
    assert ts.isoformat() == "2024-01-01T00:00:00.123456"


def test_json_is_parsed_once(spark):
    rows = spark.createDataFrame([(1, batch(event()))], "batch_id bigint, payload string")
    checked = ingest.check(ingest.decode(rows))
    for frame in (ingest.violations(checked), ingest.accepted_events(checked), ingest.acks(checked)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1
        assert "Aggregate" not in plan


def test_log_rows(spark):
    payload = batch(
        event(span_id="", trace_id="t", log_attributes={"bad key": 1}, resource_attributes={}),
        event(log_attributes={}, resource_attributes={"host.name": "h"}),
    )
    rows = spark.createDataFrame([(1, payload), (2, batch(event(body="")))], "batch_id bigint, payload string")
    logs = ingest.to_log_rows(ingest.check(ingest.decode(rows)), base=10).orderBy("id").collect()
    assert [r["id"] for r in logs] == [11, 12]
    assert (logs[0]["trace_id"], logs[0]["span_id"]) == ("t", None)
    assert (logs[0]["log_attributes"], logs[0]["resource_attributes"]) == ('{"bad_key":1}', None)
    assert (logs[1]["log_attributes"], logs[1]["resource_attributes"]) == (None, '{"host.name":"h"}')
    assert logs[0]["received_at"] is not None


def test_inflate(spark):
    text = batch(event()).encode()
    whole = gzip.compress(text)
    cases = {
        "plain": (text, ""),
        "zip": (whole, "gzip"),
        "two members": (gzip.compress(text[:9]) + gzip.compress(text[9:]), "gzip"),
        "no header": (text, "gzip"),
        "empty": (b"", "gzip"),
        "cut": (whole[:-9], "gzip"),
        "bomb": (gzip.compress(b"x" * 3_000_000), "gzip"),
    }
    rows = spark.createDataFrame(
        [(k, bytearray(b), e) for k, (b, e) in cases.items()], "batch_id string, body binary, encoding string"
    )
    got = {r["batch_id"]: (r["payload"], r["problem"]) for r in inflate(rows, 1_000_000).collect()}
    good = (text.decode(), None)
    assert got["plain"] == got["zip"] == got["two members"] == good
    assert got["no header"][1] == got["empty"][1] == "invalid-encoding"
    assert got["cut"][1] == "invalid-json"
    assert got["bomb"] == (None, "payload-too-large")
    problems = {r["batch_id"]: r["problem"] for r in ingest.check(ingest.decode(inflate(rows, 1_000_000))).collect()}
    assert problems["bomb"] == "payload-too-large" and problems["cut"] == "invalid-json" and problems["zip"] is None


def test_read_payload_files(spark, tmp_path):
    from cinderlog.sources.payloads import read_payload_files

    (tmp_path / "a.json").write_bytes(batch(event()).encode())
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(batch(event(), event()).encode()))
    checked = ingest.check(ingest.decode(inflate(read_payload_files(spark, str(tmp_path)))))
    assert sorted(r["n_events"] for r in ingest.verdicts(checked).where("accepted").collect()) == [1, 2]


def test_invalid_utf8_does_not_stop_the_job(spark):
    good = batch(event(body="ok")).encode()
    broken = batch(event(body="@@")).encode().replace(b"@@", b"\xff\xfe")
    rows = spark.createDataFrame(
        [("a", bytearray(good), ""), ("b", bytearray(broken), ""), ("c", bytearray(gzip.compress(broken)), "gzip"),
         ("d", bytearray(b"\xff\xff"), "")], "batch_id string, body binary, encoding string",
    )
    checked = ingest.check(ingest.decode(inflate(rows)))
    got = {r["batch_id"]: r["body"] for r in ingest.accepted_events(checked).collect()}
    assert got == {"a": "ok", "b": "\ufffd\ufffd", "c": "\ufffd\ufffd"}
    raw = rows.select("batch_id", F.col("body").cast("string").alias("payload")).where("batch_id in ('b', 'd')")
    problems = {r["batch_id"]: r["problem"] for r in ingest.check(ingest.decode(raw)).collect()}
    assert problems == {"b": None, "d": "invalid-json"}


def test_json_edges_of_payloads(spark):
    """Numbers beyond 64-bit floats are no JSON; white space around null is."""
    event = '{"events":[{"timestamp":"2024-01-01T00:00:00Z","severity":"info","body":"%s","service_name":"s","log_attributes":{"n":%s}}]}'
    cases = [event % ("b", "1e400"), event % ("b", "-1E+999"), event % ("1e400 \\\" 1e999", "1e300"), event % ("b", "9" * 400), "null\n", " null\t"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(cases)], "batch_id int, payload string")
    got = {r["batch_id"]: r["problem"] for r in ingest.decode(rows).collect()}
    assert [got[i] for i in range(6)] == [fixed.PROBLEM_JSON, fixed.PROBLEM_JSON, None, fixed.PROBLEM_JSON, None, None]
