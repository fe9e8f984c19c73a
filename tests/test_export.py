"""Packing against a plain fold, and the wire form."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from cinderlog.functions import keys
from cinderlog.operators import export, ingest

T0 = dt.datetime(2024, 1, 1)


def fold(events, max_events, max_bytes, interval):
    """Batch number of each event of one producer, in order."""
    out, number, n, size, began = [], -1, 0, 0, None
    for ts, bytes_ in events:
        if n == 0 or n >= max_events or size >= max_bytes or ts - began >= interval:
            number, n, size, began = number + 1, 0, 0, ts
        n, size = n + 1, size + bytes_
        out.append(number)
    return out


@pytest.mark.parametrize("max_events, max_bytes, seconds", [(5, 10**9, 1e6), (5, 900, 1e6), (7, 10**9, 30), (6, 1200, 45), (1, 50, 1)])
def test_pack(spark, max_events, max_bytes, seconds):
    rng = random.Random(max_bytes + max_events)
    rows, clock = [], {}
    for i in range(900):
        p = "hot" if i % 3 else f"p{i % 4}"
        clock[p] = clock.get(p, 0) + rng.choice([0, 1, 5, 40, 200])
        rows.append((i, p, T0 + dt.timedelta(seconds=clock[p]), rng.randrange(100, 500)))
    frame = spark.createDataFrame(rows, "id int, producer string, ts timestamp_ntz, size int").repartition(5)
    packed = export.pack_batches(frame, "producer", ["ts", "id"], "size", max_events, max_bytes, seconds, chunk_rows=max(7, max_events), slices=6)
    got = {r["id"]: r["batch_no"] for r in packed.collect()}
    for p in {r[1] for r in rows}:
        mine = sorted((r[2], r[0], r[3]) for r in rows if r[1] == p)
        want = fold([(ts, size) for ts, _, size in mine], max_events, max_bytes, dt.timedelta(seconds=seconds))
        assert [got[i] for _, i, _ in mine] == want, p


def test_pack_many_chunk_levels(spark, monkeypatch):
    monkeypatch.setattr(export, "_FAN", 3)
    rng = random.Random(3)
    rows = [(i, "p", T0 + dt.timedelta(seconds=i * 3), rng.randrange(1, 9)) for i in range(400)]
    frame = spark.createDataFrame(rows, "id int, producer string, ts timestamp_ntz, size int")
    packed = export.pack_batches(frame, "producer", ["ts", "id"], "size", 4, 15, 9, chunk_rows=5)
    got = [r["batch_no"] for r in packed.orderBy("id").collect()]
    assert got == fold([(r[2], r[3]) for r in rows], 4, 15, dt.timedelta(seconds=9))


def test_one_hot_producer_uses_many_tasks(spark):
    frame = spark.range(2000).select(
        F.col("id"), F.lit("p").alias("producer"), F.lit(T0).cast("timestamp_ntz").alias("ts"), F.lit(1).alias("size")
    )
    packed = export.pack_batches(frame, "producer", ["ts", "id"], "size", max_events=10, chunk_rows=100)
    assert packed.groupBy("batch_no").count().where("count <> 10").count() == 0


FIELD = "struct<key: string, type: string, string_val: string, int64_val: bigint, float64_val: double, bool_val: boolean, json_val: string>"


def f(key, kind, **v):
    return (key, kind, v.get("s"), v.get("i"), v.get("d"), v.get("b"), v.get("j"))


def test_wire_event_reads_back(spark):
    fields = [
        f("trace_id", "string", s="t" * 32), f("span_id", "string", s="s" * 16), f("n", "int64", i=2**53 + 1),
        f("x", "float64", d=0.1), f("ok", "bool", b=False), f("d", "duration", i=1_500_000_000), f("d2", "duration", i=1_500_000),
        f("e", "error", s="quote \" slash \\ nl\n tab\t ctl\x01 é"), f("l", "string_slice", j='["a","b"]'),
        f("m", "map", j='{"k":"v"}'), f("o", "object", j='{"a":{"b":1}}'), f("nil", "any", j="null"), f("bad", "any", j="{oops"),
        f("dup", "string", s="first"), f("dup", "int64", i=2),
    ]
    rows = spark.createDataFrame(
        [(1, T0, "msg <&>", fields), (2, T0.replace(microsecond=120000), "none", []), (3, T0, "only ids", fields[:2])],
        f"id int, ts timestamp_ntz, m string, fields array<{FIELD}>",
    )
    res = {k: F.lit(v) for k, v in {"service.name": "svc", "service.version": "1", "deployment.environment": "e", "host.name": "h"}.items()}
    res["process.pid"] = F.lit(42)
    got = {
        r["id"]: json.loads(r["e"])
        for r in rows.select("id", export.wire_event(F.col("ts"), F.lit("warn"), F.col("m"), F.col("fields"), res).alias("e")).collect()
    }
    assert got[1]["log_attributes"] == {
        "n": 2**53 + 1, "x": 0.1, "ok": False, "d": 1500, "d2": 1.5, "e": fields[7][2], "l": ["a", "b"], "m": {"k": "v"},
        "o": {"a": {"b": 1}}, "nil": None, "bad": "{oops", "dup": 2,
    }
    assert (got[1]["trace_id"], got[1]["span_id"]) == ("t" * 32, "s" * 16)
    assert got[1]["timestamp"] == "2024-01-01T00:00:00Z" and got[2]["timestamp"] == "2024-01-01T00:00:00.12Z"
    assert "log_attributes" not in got[2] and "trace_id" not in got[2] and "log_attributes" not in got[3]
    assert got[2]["resource_attributes"] == {"service.name": "svc", "service.version": "1", "deployment.environment": "e", "host.name": "h", "process.pid": 42}


def test_exported_payloads_are_accepted(spark):
    rows = spark.createDataFrame([(i, "p", T0, f"m{i}", [f("a", "int64", i=i)], 10) for i in range(7)],
                                 f"id int, producer string, ts timestamp_ntz, m string, fields array<{FIELD}>, size int")
    packed = export.pack_batches(rows, "producer", ["ts", "id"], "size", max_events=3, chunk_rows=3)
    res = {k: F.lit("x") for k in ("service.name", "service.version", "deployment.environment", "host.name", "process.pid")}
    events = packed.withColumn("event", export.wire_event(F.col("ts"), F.lit("info"), F.col("m"), F.col("fields"), res))
    payloads = export.wire_batches(events, "producer", ["ts", "id"])
    checked = ingest.check(ingest.decode(payloads.withColumnRenamed("batch_no", "batch_id")))
    assert sorted(r["n_events"] for r in ingest.verdicts(checked).where("accepted").collect()) == [1, 3, 3]
    bodies = [r["body"] for r in ingest.accepted_events(checked).orderBy("batch_id", "event_index").collect()]
    assert bodies == [f"m{i}" for i in range(7)]


def test_estimate_size(spark):
    rows = spark.createDataFrame([("é", [f("key", "string", s="ab"), f("n", "int64", i=1)]), ("x", [])], f"m string, fields array<{FIELD}>")
    got = [r[0] for r in rows.select(keys.estimate_size(F.col("m"), F.col("fields"))).collect()]
    assert got == [128 + 2 + (3 + 8 + 2) + (1 + 8), 129]
