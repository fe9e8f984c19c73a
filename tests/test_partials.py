"""Tiered merging of partial counts: sums, replays, crashes, retention."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import ledger, partials, rollup

COUNTS = "service_name string, severity string, hour timestamp_ntz, count bigint"
T0 = dt.datetime(2024, 1, 10, 7)


def add(spark, path, batch, days=(0,), writer="w", count=1):
    rows = [("api", "info", T0 + dt.timedelta(days=d), count) for d in days]
    partials.append(spark.createDataFrame(rows, COUNTS), path, writer, batch)


def sums(spark, path):
    return {r["hour"]: r["count"] for r in rollup.merge_counts(partials.read(spark, path)).collect()}


def loads_of_days(spark, path):
    seen = partials.read(spark, path).select("event_date", "load").distinct()
    return {r["event_date"].day: r["n"] for r in seen.groupBy("event_date").agg(F.count("*").alias("n")).collect()}


def names(path):
    return {p.name for p in (path / "_loads").glob("[!.]*")}


def test_tiers_bound_the_loads_of_a_day(spark, tmp_path):
    path = str(tmp_path / "t")
    taken = []
    for batch in range(10):
        add(spark, path, batch, days=(0, 1) if batch % 2 else (0,))
        taken.append(partials.compact(spark, path, fanout=2))
    # Day 10 got ten loads, 8 + 2; day 11 got five, 4 + 1.
    assert loads_of_days(spark, path) == {10: 2, 11: 2}
    assert sums(spark, path) == {T0: 10, T0 + dt.timedelta(days=1): 5}
    assert sum(taken) == 2 * (5 + 2 + 1) + 2 * (2 + 1)
    assert partials.compact(spark, path, fanout=2) == 0


def test_replay_after_merging_and_sweeping_counts_once(spark, tmp_path):
    path = tmp_path / "t"
    for batch in range(4):
        add(spark, str(path), batch)
    add(spark, str(path), 0, writer="other")
    partials.compact(spark, str(path), fanout=2)
    assert partials.sweep(spark, str(path)) == 6
    assert {"w-3", "other-0"} <= names(path) and not names(path) & {"w-0", "w-1", "w-2"}
    add(spark, str(path), 3)
    add(spark, str(path), 0, writer="other")
    assert sums(spark, str(path)) == {T0: 5}
    assert partials.sweep(spark, str(path)) == 0
    add(spark, str(path), 4)
    assert sums(spark, str(path)) == {T0: 6}


def test_a_load_over_two_days_keeps_its_other_day(spark, tmp_path):
    path = tmp_path / "t"
    add(spark, str(path), 0, days=(0, 1))
    add(spark, str(path), 1)
    assert partials.compact(spark, str(path), fanout=2) == 2
    partials.sweep(spark, str(path))
    assert sums(spark, str(path)) == {T0: 2, T0 + dt.timedelta(days=1): 1}
    assert "w-0" in names(path)


@pytest.mark.parametrize("few", [0, 10_000])
def test_reading_is_the_same_with_a_joined_ledger(spark, tmp_path, monkeypatch, few):
    path = str(tmp_path / "t")
    for batch in range(5):
        add(spark, path, batch, days=(0, 1))
    monkeypatch.setattr(ledger, "FEW_LOADS", few)
    partials.compact(spark, path, fanout=2)
    assert sums(spark, path) == {T0: 5, T0 + dt.timedelta(days=1): 5}
    assert loads_of_days(spark, path) == {10: 2, 11: 2}


def test_a_compaction_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    path = tmp_path / "t"
    for batch in range(2):
        add(spark, str(path), batch, days=(0, 1))
    commit, left = ledger.commit, [1]

    def once(*args, **facts):
        if not left:
            raise OSError("lost")
        left.pop()
        commit(*args, **facts)

    with monkeypatch.context() as broken:
        broken.setattr(ledger, "commit", once)
        with pytest.raises(OSError, match="lost"):
            partials.compact(spark, str(path), fanout=2)
    want = {T0: 2, T0 + dt.timedelta(days=1): 2}
    assert sums(spark, str(path)) == want
    partials.sweep(spark, str(path))  # the written but never committed day goes
    assert sums(spark, str(path)) == want
    assert partials.compact(spark, str(path), fanout=2) == 2
    assert sums(spark, str(path)) == want and loads_of_days(spark, str(path)) == {10: 1, 11: 1}


def test_expired_days_go_with_their_ledger_files(spark, tmp_path):
    path = tmp_path / "t"
    for batch in range(4):
        add(spark, str(path), batch, days=(0, 5))
    partials.compact(spark, str(path), fanout=2)
    day = T0 + dt.timedelta(days=30)
    assert partials.expire(spark, str(path), day) == 0  # the newest hour is exactly 30 days old
    assert partials.expire(spark, str(path), day + dt.timedelta(seconds=1)) == 1
    partials.sweep(spark, str(path))
    assert sums(spark, str(path)) == {T0 + dt.timedelta(days=5): 4}
    assert len(names(path)) == 2  # the last micro-batch and the merged load of the day that is left
    add(spark, str(path), 4)  # so late that its day had gone
    assert sums(spark, str(path))[T0] == 1


def test_null_hours_and_empty_loads(spark, tmp_path):
    path = str(tmp_path / "t")
    empty = spark.createDataFrame([], COUNTS)
    partials.append(empty, path, "w", 0)
    nothing = spark.createDataFrame([("api", None, None, 2)], COUNTS)
    for batch in (1, 2):
        partials.append(nothing, path, "w", batch)
        add(spark, path, batch + 10)
    assert partials.compact(spark, path, fanout=2) == 2
    partials.sweep(spark, path)
    assert sums(spark, path) == {None: 4, T0: 2}


def test_fanout_is_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        partials.compact(spark, str(tmp_path), fanout=1)
