"""Sink, retention, reconciliation, dedup and traces."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from cinderlog.fixed import LOG_COLUMNS
from cinderlog.functions.times import ntz
from cinderlog.operators import dedup, ledger, reconcile, retention, search, sinks, stored, traces
from cinderlog.plans import streams
from cinderlog.session import shared_dir
from cinderlog.sources import tables


def write(spark, sf_dir, path, **kw):
    sinks.append_logs(tables.event_logs(spark, sf_dir).select(*LOG_COLUMNS), path, "a", **kw)


def test_empty_append_writes_nothing(spark, sf_dir, tmp_path):
    path = str(tmp_path / "t")
    write(spark, sf_dir, path)
    before = sinks.read_logs(spark, path).count()
    sinks.append_logs(tables.event_logs(spark, sf_dir).select(*LOG_COLUMNS).where("id < 0"), path, "b")
    assert sinks.read_logs(spark, path).count() == before == 1000


def test_promoted_column_and_terms(spark, sf_dir, tmp_path):
    path = str(tmp_path / "t")
    write(spark, sf_dir, path, promote={"role": ["user", "role"]}, with_terms=True)
    stored = sinks.read_logs(spark, path, "role string, body_terms array<string>")
    assert stored.where("role = 'r0'").count() == 143
    assert stored.where(F.array_contains("body_terms", "by")).count() == 0


def test_few_files_per_day(spark, sf_dir, tmp_path):
    path = str(tmp_path / "t")
    write(spark, sf_dir, path)
    for day in os.listdir(path):
        if day.startswith("event_date="):
            files = [f for f in os.listdir(f"{path}/{day}/load=a") if f.endswith(".parquet")]
            assert len(files) <= 5  # at most one per service


def test_drop_old_days(spark, sf_dir, tmp_path):
    path = str(tmp_path / "t")
    write(spark, sf_dir, path)
    as_of = dt.datetime(2024, 1, 28, 15)
    logs = sinks.read_logs(spark, path)
    plan = retention.by_partition_start(logs, ntz(as_of)).where("dropped").collect()
    kept = logs.where("event_date >= '2024-01-15'").count()
    os.mkdir(f"{path}/event_date=oops")  # not a day, left alone
    assert retention.drop_old_days(spark, path, as_of) == len(plan) == 14
    assert {r["event_date"] for r in plan} == {dt.date(2024, 1, d) for d in range(1, 15)}
    assert os.path.isdir(f"{path}/event_date=oops")
    assert retention.drop_old_days(spark, path, as_of) == 0
    os.rmdir(f"{path}/event_date=oops")
    assert sinks.read_logs(spark, path).count() == kept


def test_boundary_day_by_either_rule(spark):
    t = dt.datetime(2024, 1, 14, 20)
    logs = spark.createDataFrame([(t,), (t.replace(hour=1),)], "timestamp timestamp_ntz").withColumn("event_date", F.to_date("timestamp"))
    as_of = dt.datetime(2024, 1, 28, 15)
    assert retention.by_partition_start(logs, ntz(as_of)).first()["dropped"]  # its start is too old
    assert not retention.by_row_age(logs, ntz(as_of)).first()["dropped"]  # its last row is not
    assert retention.by_row_age(logs, ntz(as_of + dt.timedelta(hours=6))).first()["dropped"]


def test_dedup_keeps_the_first(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 1, "only")], "k string, at int, v string")
    assert sorted(tuple(r) for r in dedup.dedup(rows, ["k"], ["at"]).collect()) == [("a", 1, "early"), ("b", 1, "only")]
    hot = spark.range(5000).select(F.lit("hot").alias("k"), F.col("id").alias("at"), F.lit("x").alias("v"))
    assert dedup.dedup(hot, ["k"], ["at"]).first()["at"] == 0


def test_reconcile(spark):
    ddl = "m string, s int, body string"
    sent = spark.createDataFrame([("m", i, f"b{i}") for i in range(6)], ddl)
    store = spark.createDataFrame([("m", 0, "b0"), ("m", 1, "b1"), ("m", 1, "b1"), ("m", 2, "changed"), ("m", 4, None), ("m", 5, "b5"), ("m", 9, "b9")], ddl)
    row = reconcile.reconcile(reconcile.compare_events(sent, store, ["m", "s"], ["body"]), ["m"]).first()
    assert row.asDict() == {
        "m": "m", "expected": 6, "stored": 7, "missing": 1, "duplicated": 1, "unexpected": 1, "altered": 2, "passed": False
    }
    same = reconcile.reconcile(reconcile.compare_events(sent, sent, ["m", "s"], ["body"]), ["m"]).first()
    assert same["passed"]


def test_trace_tree(spark):
    chain = [("t", str(i), "" if i == 0 else str(i - 1)) for i in range(40)]
    rest = [("t", "lost", "nowhere"), ("t", "below", "lost"), ("t", "x", "y"), ("t", "y", "x"), ("t", "self", "self"),
            ("u", "1", None), ("u", "2", "1"), ("v", "2", "1")]
    spans = spark.createDataFrame(chain + rest, "trace_id string, span_id string, parent_span_id string")
    got = {(r["trace_id"], r["span_id"]): (r["root_span_id"], r["depth"]) for r in traces.trace_tree(spans).collect()}
    assert len(got) == len(chain) + len(rest)
    assert all(got[("t", str(i))] == ("0", i) for i in range(40))
    assert got[("u", "1")] == ("1", 0) and got[("u", "2")] == ("1", 1)
    for lost in [("t", "lost"), ("t", "below"), ("t", "x"), ("t", "y"), ("t", "self"), ("v", "2")]:
        assert got[lost] == (None, None)


def test_correlate_keeps_rows_without_ids(spark):
    logs = spark.createDataFrame([(1, "t", "a"), (2, None, "a"), (3, "t", None), (4, "t", "zz")], "id int, trace_id string, span_id string")
    spans = spark.createDataFrame([("t", "a", "op")], "trace_id string, span_id string, operation_name string")
    got = {r["id"]: r["span_operation_name"] for r in traces.correlate(logs, spans).collect()}
    assert got == {1: "op", 2: None, 3: None, 4: None}


@pytest.mark.parametrize("few", [1000, 0])
def test_compaction_is_one_step(spark, sf_dir, tmp_path, monkeypatch, few):
    monkeypatch.setattr(ledger, "FEW_LOADS", few)
    path = str(tmp_path / "t")
    logs = tables.event_logs(spark, sf_dir).select(*LOG_COLUMNS)
    parts = {load: logs.where(F.col("id") % 3 == "abc".index(load)) for load in "abc"}
    for load, rows in parts.items():
        sinks.append_logs(rows, path, load)
    day = "2024-01-02"

    def ids(where="true"):
        return sorted(r["id"] for r in sinks.read_logs(spark, path).where(where).collect())

    want, whole = ids(f"event_date = '{day}'"), ids()
    # A run that stopped before its commit changes nothing, and the next one takes its place.
    sinks._write(sinks._clustered(sinks.read_logs(spark, path).where(f"event_date = '{day}'").withColumn("load", F.lit("packed"))), path)
    assert ids() == whole
    sinks.compact_day(spark, path, day, "packed")
    sinks.compact_day(spark, path, day, "packed")
    assert ids(f"event_date = '{day}'") == want and ids() == whole
    assert {r["load"] for r in sinks.read_logs(spark, path).where(f"event_date = '{day}'").collect()} == {"packed"}
    # Replays change nothing, before and after the old folders go.
    sinks.append_logs(parts["a"], path, "a")
    assert ids() == whole
    assert sinks.sweep_day(spark, path, day) == 3 and sinks.sweep_day(spark, path, day) == 0
    sinks.append_logs(parts["b"], path, "b")
    assert ids() == whole and os.listdir(f"{path}/event_date={day}") == ["load=packed"]
    # A late load joins the day, and a second compaction packs both.
    sinks.append_logs(logs.where("id = 40").withColumn("id", F.lit(-1).cast("bigint")), path, "late")
    late = ids(f"event_date = '{day}'")
    sinks.compact_day(spark, path, day, "again")
    assert ids(f"event_date = '{day}'") == late


def test_unfinished_load_is_not_seen(spark, sf_dir, tmp_path):
    path = str(tmp_path / "t")
    logs = tables.event_logs(spark, sf_dir).select(*LOG_COLUMNS)
    sinks.append_logs(logs.where("id < 100"), path, "a")
    half = sinks.table_rows(logs.where("id between 100 and 400")).withColumn("load", F.lit("b"))
    sinks._write(sinks._clustered(half), path)
    assert sinks.read_logs(spark, path).count() == 100
    sinks.append_logs(logs.where("id between 100 and 499"), path, "b")
    assert sinks.read_logs(spark, path).count() == 500


def test_dedup_keeps_rows_without_a_key(spark):
    from cinderlog.operators.dedup import dedup

    rows = spark.createDataFrame([(None, "x", 1), (None, "y", 2), (1, "a", 2), (1, "b", 1)], "id int, body string, n int")
    assert sorted(r["body"] for r in dedup(rows, ["id"], ["n"]).collect()) == ["b", "x", "y"]


def test_reconcile_sees_moved_nulls(spark):
    from cinderlog.operators.reconcile import compare_events

    ddl = "id int, a string, b string"
    want, have = spark.createDataFrame([(1, None, "x"), (2, None, "x")], ddl), spark.createDataFrame([(1, "x", None), (2, None, "x")], ddl)
    got = {r["id"]: r["altered"] for r in compare_events(want, have, ["id"], ["a", "b"]).collect()}
    assert got == {1: True, 2: False}


def test_trace_tree_keeps_repeated_spans(spark):
    from cinderlog.operators.traces import trace_tree

    rows = [("t", "a", ""), ("t", "b", "a"), ("t", "b", "a"), ("t", "c", "b"), ("t", "a", None), (None, "z", "")]
    got = trace_tree(spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string")).collect()
    assert len(got) == len(rows)
    assert {(r["span_id"], r["depth"]) for r in got} == {("a", 0), ("b", 1), ("c", 2), ("z", None)}


def test_aged_days_and_bounded_reads(spark, sf_dir, tmp_path):
    from cinderlog.operators import search

    path = str(tmp_path / "t")
    write(spark, sf_dir, path)
    logs = sinks.read_logs(spark, path)
    last = logs.where("event_date = '2024-01-03'").agg(F.max("timestamp")).first()[0]
    young = logs.where("event_date > '2024-01-03'").count()
    assert retention.drop_aged_days(spark, path, logs, last + dt.timedelta(days=14)) == 2
    logs = sinks.read_logs(spark, path)
    assert retention.drop_aged_days(spark, path, logs, last + dt.timedelta(days=14, seconds=1)) == 1
    logs = sinks.read_logs(spark, path)
    assert logs.count() == young
    since = dt.datetime(2024, 1, 20)
    assert search.latest(logs, 30).select("id").collect() == search.latest(logs, 30, since).select("id").collect()
    trace = logs.where("trace_id is not null and event_date = '2024-01-21'").first()["trace_id"]
    found = search.trace_lookup(logs, trace, start=dt.datetime(2024, 1, 21), end=dt.datetime(2024, 1, 22))
    assert found.count() == logs.where(F.col("trace_id") == trace).count() > 0


def _break_off(monkeypatch):
    monkeypatch.setattr(sinks, "_commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))


def test_retry_with_other_days_leaves_nothing_of_the_first_try(spark, sf_dir, tmp_path, monkeypatch):
    logs = tables.event_logs(spark, sf_dir).select(*LOG_COLUMNS)
    path, days = str(tmp_path / "t"), [r[0] for r in logs.select(F.to_date("timestamp")).distinct().orderBy(F.to_date("timestamp")).limit(2).collect()]
    day = F.to_date("timestamp")
    with monkeypatch.context() as m:
        _break_off(m)
        with pytest.raises(OSError):
            sinks.append_logs(logs.where(day.isin(days)), path, "a")
    assert sinks.read_logs(spark, path).count() == 0
    sinks.append_logs(logs.where(day == days[0]), path, "a")
    assert sinks.read_logs(spark, path).count() == logs.where(day == days[0]).count()


def test_retention_keeps_loads_in_flight(spark, sf_dir, tmp_path, monkeypatch):
    logs, path = tables.event_logs(spark, sf_dir).select(*LOG_COLUMNS), str(tmp_path / "t")
    sinks.append_logs(logs.where("id % 2 = 0"), path, "a")
    with monkeypatch.context() as m:
        _break_off(m)
        with pytest.raises(OSError):
            sinks.append_logs(logs.where("id % 2 = 1"), path, "b")
    late = dt.datetime(2100, 1, 1)
    assert retention.drop_old_days(spark, path, late) == 0
    sinks._commit(spark, path, "b")
    assert sinks.read_logs(spark, path).count() == logs.where("id % 2 = 1").count()
    assert retention.drop_old_days(spark, path, late) > 0


def indexed(spark, sf_dir, path, load, **kw):
    rows = tables.event_logs(spark, sf_dir).select(*LOG_COLUMNS)
    sinks.append_logs(rows.where(F.col("id") % 3 == int(load)), path, load, **kw)


def found(spark, path, keyword, **kw):
    q = search.LogQuery(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 20), keyword=keyword, max_range_days=40, **kw)
    want = search.filtered(sinks.read_logs(spark, path), q)
    got = stored.matching(spark, path, q)
    ids = sorted(r["id"] for r in got.collect())
    assert ids == sorted(r["id"] for r in want.collect()), keyword
    return ids


def test_stored_search_reads_the_index(spark, sf_dir, tmp_path):
    path = str(tmp_path / "t")
    for load in "012":
        indexed(spark, sf_dir, path, load, index="english")
    user = tables.event_logs(spark, sf_dir).where("service_name = 'svc-3'").first()["body"].split()[-1]
    assert found(spark, path, f"users {user}") and found(spark, path, "clicks by the user", level="info")
    assert found(spark, path, "by the") == []  # stop words only
    assert found(spark, path, "absent") == []
    hits = stored.matching(spark, path, search.LogQuery(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 5, 23, 59, 59, 999999), keyword=f"user {user}"))
    days = {str(r["event_date"]) for r in hits.select(F.to_date("timestamp").alias("event_date")).collect()}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    read = {frozenset(re.split(", ?", found)) for found in re.findall(r"event_date#\d+ IN \(([^)]*)\)", plan)}
    assert len(days) < 6 and read == {frozenset(days)}, plan


def test_stored_search_is_whole_without_index_after_compaction_and_a_crash(spark, sf_dir, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    indexed(spark, sf_dir, path, "0", index="english")
    indexed(spark, sf_dir, path, "1", index="english")
    before = found(spark, path, "click user")
    with monkeypatch.context() as broken:
        broken.setattr(sinks, "_commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            indexed(spark, sf_dir, path, "2", index="english")
    assert found(spark, path, "click user") == before
    day = sinks.read_logs(spark, path).agg(F.min("event_date")).first()[0]
    sinks.compact_day(spark, path, str(day), "packed")
    assert found(spark, path, "click user") == before
    sinks.sweep_day(spark, path, str(day))
    assert found(spark, path, "click user") == before
    assert os.listdir(f"{path}/_terms/event_date={day}") and "load=0" not in os.listdir(f"{path}/_terms/event_date={day}")
    indexed(spark, sf_dir, path, "2")  # the retry has no index
    assert len(found(spark, path, "click user")) > len(before)
    assert not any("load=2" in names for _, names, _ in os.walk(f"{path}/_terms"))
    retention.drop_old_days(spark, path, dt.datetime.combine(day, dt.time()) + dt.timedelta(days=2), days=1)
    assert not os.path.exists(f"{path}/_terms/event_date={day}")
    found(spark, path, "click user")


def test_postings_of_a_lopsided_load_are_made_by_all_cores(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(400).selectExpr(
        "id", "timestamp_ntz'2024-01-01 00:00:00' as timestamp", "'svc' as service_name", "'info' as severity",
        "concat('word', id) as body", "null as resource_attributes", "null as log_attributes")
    sinks._write(rows.selectExpr("*", "date'2024-01-01' as event_date", "'a' as load").coalesce(1), path)
    of_load = sinks._of_load(spark, path, "a")
    sizes = [r["count"] for r in of_load.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 200 and sum(sizes) == 400
    assert sorted(r["id"] for r in of_load.collect()) == list(range(400))


def test_events_are_dealt_before_they_become_wide(spark, sf_dir):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tables.raw_attributes(spark, sf_dir).rdd.getNumPartitions() == parts


def test_payload_text_is_made_behind_the_only_exchange(spark, sf_dir):
    plan = tables.payloads(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange " in line]
    assert len(exchanges) == 1 and "batch_id" in exchanges[0] and "span_id" not in plan[plan.index("Exchange "):]


def test_arriving_files_can_be_read_by_more_tasks_than_files(spark):
    from pyarrow import parquet

    text = "array_join(transform(sequence(1, 3000), x -> md5(concat(id, '-', x))), '') as payload"
    streams._arriving(spark, spark.range(400).selectExpr("id as batch_id", text), "wide", files=1)
    home = os.path.join(shared_dir(spark).removeprefix("file:"), "cinderlog")
    (folder,) = [os.path.join(home, f) for f in os.listdir(home) if f.startswith("wide-")]
    (file,) = [f for f in os.listdir(folder) if f.endswith(".parquet")]
    assert parquet.ParquetFile(os.path.join(folder, file)).num_row_groups > 1
