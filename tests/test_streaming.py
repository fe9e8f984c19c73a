"""Streams compared with batch results, late rows and replays."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import rollup, sinks
from cinderlog.operators.search import LogQuery
from cinderlog.sources import topic
from cinderlog.streaming import jobs

LOG = "id bigint, timestamp timestamp_ntz, service_name string, severity string, body string"
T0 = dt.datetime(2024, 1, 10)


def row(i, hours=0, service="api", severity="info"):
    return (i, T0 + dt.timedelta(hours=hours), service, severity, f"request {i} failed")


def add(spark, path, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)


def test_late_rows_are_counted(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / p) for p in ("src", "out", "ckpt"))
    add(spark, src, [row(1), row(2, 1)])
    stream = lambda: topic.folder_payloads(spark, src, schema=LOG)
    jobs.hourly_counts_stream(stream(), out, ckpt).awaitTermination()
    add(spark, src, [row(3, -24 * 9), row(4, 1)])  # nine days late
    jobs.hourly_counts_stream(stream(), out, ckpt).awaitTermination()
    got = {tuple(r) for r in jobs.read_hourly_counts(spark, out).collect()}
    want = {tuple(r) for r in rollup.hourly_counts(spark.read.schema(LOG).parquet(src)).collect()}
    assert got == want and len(got) == 3


def test_replayed_micro_batch_does_not_double(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    add(spark, src, [row(i, i % 3) for i in range(30)])
    for ckpt in ("a", "b"):  # a lost checkpoint makes batch 0 run again
        stream = topic.folder_payloads(spark, src, schema=LOG)
        jobs.hourly_counts_stream(stream, out, str(tmp_path / ckpt)).awaitTermination()
    assert jobs.read_hourly_counts(spark, out).agg(F.sum("count")).first()[0] == 30


def payload(*bodies):
    events = [{"timestamp": "2024-01-01T00:00:00Z", "service_name": "api", "severity": "info", "body": b} for b in bodies]
    return json.dumps({"events": events})


def test_ingest_stream_and_its_replay(spark, tmp_path):
    src, logs, rejects = (str(tmp_path / p) for p in ("src", "logs", "rejects"))
    rows = [(1, payload("a", "b")), (2, payload("c", "")), (3, "not json"), (4, payload("d"))]
    spark.createDataFrame(rows, "batch_id bigint, payload string").repartition(2).write.parquet(src)
    for _ in range(2):
        stream = topic.folder_payloads(spark, src)
        jobs.ingest_stream(stream, logs, rejects, str(tmp_path / "ckpt")).awaitTermination()
        # As after a crash between the load's commit and the micro-batch's: it runs again.
        for done in (tmp_path / "ckpt" / "commits").glob("*"):
            done.unlink()
    assert len(list((tmp_path / "logs" / "_loads").glob("[!.]*"))) == 1
    stored = sinks.read_logs(spark, logs).collect()
    assert sorted(r["body"] for r in stored) == ["a", "b", "d"]
    assert len({r["id"] for r in stored}) == 3
    bad = {r["batch_id"]: r["problem"] for r in spark.read.parquet(rejects).collect()}
    assert bad == {2: "validation-failed", 3: "invalid-json"}


def test_throughput_drops_only_what_is_later_than_the_delay(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / p) for p in ("src", "out", "ckpt"))
    stream = lambda: topic.folder_payloads(spark, src, schema=LOG)
    add(spark, src, [row(1), row(2, 5)])
    jobs.throughput_stream(stream(), out, ckpt, delay="1 hour").awaitTermination()
    add(spark, src, [row(3, 5), row(4, -5)])
    jobs.throughput_stream(stream(), out, ckpt, delay="1 hour").awaitTermination()
    got = {r["window_start"]: (r["events"], r["rate"]) for r in jobs.read_throughput(spark, out).collect()}
    assert got == {T0: (1, 0.1), T0 + dt.timedelta(hours=5): (2, 0.2)}


def test_tail_follows_new_rows_once(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / p) for p in ("src", "out", "ckpt"))
    stream = lambda: topic.folder_payloads(spark, src, schema=LOG)
    add(spark, src, [row(1, severity="error"), row(2), row(3, service="web", severity="error")])
    jobs.tail_stream(stream(), out, ckpt, "api", "warn", "failing requests").awaitTermination()
    add(spark, src, [row(4, severity="fatal")])
    jobs.tail_stream(stream(), out, ckpt, "api", "warn", "failing requests").awaitTermination()
    assert sorted(r["id"] for r in spark.read.schema(LOG).parquet(out).collect()) == [1, 4]
    with pytest.raises(ValueError):
        jobs.tail_stream(stream(), out, ckpt, seconds=7)


def test_poll_continues_from_the_last_row(spark):
    ddl = LOG + ", received_at timestamp_ntz, severity_text string, trace_id string, span_id string, resource_attributes string, log_attributes string, schema_url string"
    frame = lambda n: spark.createDataFrame([row(i) + (T0, None, None, None, None, None, None) for i in range(n)], ddl)
    q = LogQuery(T0, T0 + dt.timedelta(days=1))
    rows, cursor = jobs.poll(frame(3), q)
    assert len(rows) == 3
    again, same = jobs.poll(frame(3), LogQuery(q.start, q.end, cursor=cursor))
    assert again == [] and same == cursor
    more, _ = jobs.poll(frame(5), LogQuery(q.start, q.end, cursor=cursor))
    assert [r["id"] for r in more] == [3, 4]


def test_kafka_source_needs_its_package(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        topic.topic_payloads(spark, "localhost:1", "logs")


def test_two_ingest_streams_lose_nothing(spark, tmp_path):
    """Streams with checkpoints of their own number their micro-batches alike, and so does one that begins anew."""
    logs, rejects = str(tmp_path / "logs"), str(tmp_path / "rejects")
    for name, bodies in (("one", ("a", "")), ("two", ("b", "c"))):
        src = str(tmp_path / name)
        spark.createDataFrame([(i, payload(b)) for i, b in enumerate(bodies)], "batch_id bigint, payload string").write.parquet(src)
        jobs.ingest_stream(topic.folder_payloads(spark, src), logs, rejects, str(tmp_path / f"ckpt-{name}")).awaitTermination()
    stored = sinks.read_logs(spark, logs).collect()
    assert sorted(r["body"] for r in stored) == ["a", "b", "c"] and len({r["id"] for r in stored}) == 3
    assert spark.read.parquet(rejects).count() == 1
    jobs.ingest_stream(topic.folder_payloads(spark, str(tmp_path / "two")), logs, rejects, str(tmp_path / "anew")).awaitTermination()
    again = sinks.read_logs(spark, logs).collect()
    assert sorted(r["body"] for r in again) == ["a", "b", "b", "c", "c"] and len({r["id"] for r in again}) == 5


def test_writer_numbers(spark, tmp_path):
    path = str(tmp_path / "t")
    numbers = [sinks.writer_number(spark, path, w) for w in ("x", "y", "x", "z", "y")]
    assert numbers == [0, 1, 0, 2, 1]
