"""Positions and exact ranks, with a key that holds most rows."""

import random

from pyspark.sql import functions as F

from cinderlog.operators import ranks, reports


def skewed(n=3000):
    rng = random.Random(7)
    return [("hot" if i % 3 else f"k{i % 11}", rng.randrange(50), i) for i in range(n)]


def test_positions(spark):
    rows = skewed()
    frame = spark.createDataFrame(rows, "k string, v int, id int").repartition(5)
    got = {(r["k"], r["id"]): r["p"] for r in ranks.positions(frame, ["k"], ["v", "id"], "p", 7).collect()}
    for key in {k for k, _, _ in rows}:
        for place, (_, i) in enumerate(sorted((v, i) for k, v, i in rows if k == key)):
            assert got[(key, i)] == place
    got = {r["id"]: r["p"] for r in ranks.positions(frame, [], ["v", "id"], "p", 7).collect()}
    assert got == {i: place for place, (_, i) in enumerate(sorted((v, i) for _, v, i in rows))}


def test_a_hot_key_is_split(spark):
    frame = spark.createDataFrame(skewed(), "k string, v int, id int")
    _, table = ranks.range_slices(frame, ["k"], ["v", "id"], slices=8)
    assert table.where("k = 'hot'").count() > 3


def test_values_at_ranks(spark):
    rows = skewed() + [("hot", None, -1), ("empty", None, -2)]
    frame = spark.createDataFrame(rows, "k string, v int, id int")
    got = {
        r["k"]: r
        for r in ranks.values_at_ranks(
            frame, ["k"], "v", {"p95": ranks.nearest_rank(95), "low": F.lit(0)},
            {"rows": (F.count(F.lit(1)), "sum"), "top": (F.max("id"), "max")}, 6,
        ).collect()
    }
    for key in {k for k, _, _ in rows}:
        mine = [(v, i) for k, v, i in rows if k == key]
        values = sorted(v for v, _ in mine if v is not None)
        assert got[key]["rows"] == len(mine) and got[key]["top"] == max(i for _, i in mine)
        assert got[key]["p95"] == (values[len(values) * 95 // 100] if values else None)
        assert got[key]["low"] == (values[0] if values else None)


def test_rank_is_not_the_discrete_percentile(spark):
    frame = spark.range(20).select(F.lit("a").alias("service_name"), F.col("id").alias("lag"))
    row = ranks.values_at_ranks(frame, ["service_name"], "lag", {"p95": ranks.nearest_rank(95)}).first()
    assert row["p95"] == 19


def test_no_keys(spark):
    frame = spark.range(100).withColumn("v", F.col("id") % 10)
    row = ranks.values_at_ranks(frame, [], "v", {"p": ranks.nearest_rank(50)}, {"n": (F.count(F.lit(1)), "sum")}).first()
    assert (row["p"], row["n"]) == (5, 100)


def test_row_numbers_keep_the_order(spark):
    frame = spark.range(0, 1000, 1, 6)
    for materialize in (True, False):
        got = ranks.row_numbers(frame, "n", materialize).collect()
        assert [(r["id"], r["n"]) for r in sorted(got)] == [(i, i) for i in range(1000)]


def test_minute_gaps_has_zeros(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1, 0, 0, 30)
    logs = spark.createDataFrame([(1, t), (2, t), (3, t + dt.timedelta(minutes=2, seconds=29))], "id int, timestamp timestamp_ntz")
    got = [r["event_count"] for r in reports.minute_gaps(logs, t, t + dt.timedelta(minutes=3)).orderBy("minute").collect()]
    assert got == [2, 0, 1, 0]
