"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``points`` places. Every shard stands at ``nodes`` of them and takes
the rows that hash behind the previous node, up to its quota. Rows that overflow a
full shard continue clockwise, first come first served, to the next node whose
shard has room. With quotas at most one apart that add up to the number of rows,
every shard is full in the end, so counts differ by one at most, whatever the hash
does; rows at home never move for the sake of others.

Only counts per ring point are looked at to decide this: a table whose size the
ring fixes. Rows find their place by it: the rank of a row at its point says whether it
stays at home or, numbered along all overflowing rows, which visit of a node takes it.
Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlog.llm.common import id_and_text, settle

SHARDS, NODES, POINTS = 24, 128, 1 << 16
# Copies of one row that stay together; more are dealt over further points.
LOT = 4096


def ring(spark: SparkSession, shards: int = SHARDS, nodes: int = NODES, points: int = POINTS) -> DataFrame:
    """(point, place, home) of every ring point: the next node clockwise, by number from point 0, and its shard.

    Of nodes that meet at one point the smallest shard's counts.
    """
    stands = spark.range(shards).select(F.col("id").cast("int").alias("shard")).select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("node"))
    stands = stands.groupBy(F.pmod(F.xxhash64("shard", "node"), F.lit(points)).alias("point")).agg(F.min("shard").alias("shard"))
    # One task over a table of fixed size.
    every = Window.partitionBy(F.lit(0))
    # Backwards from the end: a frame that only grows is summed up once.
    ahead = every.orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = every.orderBy("point").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min_by("shard", F.when(F.col("shard").isNotNull(), F.col("point"))).over(every)
    return spark.range(points).select(F.col("id").alias("point")).join(stands, "point", "left").select(
        "point", F.count("shard").over(before).alias("seen"), F.count("shard").over(every).alias("all"),
        F.coalesce(F.last("shard", ignorenulls=True).over(ahead), first).alias("home"),
    ).select("point", F.when(F.col("seen") < F.col("all"), F.col("seen")).otherwise(0).cast("int").alias("place"), "home")


def distinct_rows(docs: DataFrame, points: int) -> DataFrame:
    """(doc_id, size, text_crc32, lot, copies, point): equal rows counted, at most LOT to a lot."""
    text = F.col("text").cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    lots = counted.withColumn("lot", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {LOT}"))))
    return lots.select(
        "doc_id", "size", "text_crc32", "lot", F.least(F.lit(LOT), F.col("copies") - F.col("lot") * LOT).alias("copies"),
        F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "lot"), F.lit(points)).alias("point"),
    )


def quota(total: Column, shard: Column, shards: int) -> Column:
    """Rows a shard takes: all quotas add up to ``total`` and are at most one apart."""
    return F.floor(total / shards) + F.when(shard < total % shards, 1).otherwise(0)


def walk(visits: Column, free: Column, line: Column) -> Column:
    """Who takes which overflowing rows: array of (lo, hi, shard) along the line of all of them.

    ``visits`` are nodes clockwise with (shard, entered): rows of the line that have
    come so far. Every visit serves the line from where the last one stopped.
    """
    takes = lambda s, v: F.least(F.element_at(s["free"], v["shard"] + 1), v["entered"] - s["served"])

    def step(s, v):
        n = takes(s, v)
        left = F.transform(s["free"], lambda f, i: F.when(i == v["shard"], f - n).otherwise(f))
        taken = F.array(F.struct(s["served"].alias("lo"), (s["served"] + n).alias("hi"), v["shard"].alias("shard")))
        moved = F.struct((s["served"] + n).alias("served"), left.alias("free"), F.concat(s["out"], taken).alias("out"))
        return F.when(n > 0, moved).otherwise(s)

    start = F.struct(
        F.lit(0).cast("long").alias("served"), free.alias("free"),
        F.array().cast("array<struct<lo:bigint,hi:bigint,shard:int>>").alias("out"))
    return F.when(line > 0, F.aggregate(visits, start, step)["out"]).otherwise(start["out"])


def allocate(counts: DataFrame, places: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(point, spans): where the rows of each ring point go, as array of (lo, shard, slot) by rank at the point.

    ``counts`` has (point, n), ``places`` is the ring. All tables here have at most
    one row per ring point.
    """
    at = places.join(counts, "point", "left").select("point", "place", "home", F.coalesce("n", F.lit(0)).alias("n"))
    every, clockwise = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("point")
    past = Window.unboundedPreceding
    own = Window.partitionBy("home").orderBy("point").rowsBetween(past, -1)
    at = at.withColumn("room", quota(F.sum("n").over(every), F.col("home"), shards)).withColumn(
        "before", F.coalesce(F.sum("n").over(own), F.lit(0)))
    at = at.withColumn("kept", F.greatest(F.lit(0), F.least("n", F.col("room") - F.col("before"))))
    at = at.withColumn("line", F.coalesce(F.sum(F.col("n") - F.col("kept")).over(clockwise.rowsBetween(past, -1)), F.lit(0)))
    # What each node has seen enter the line when it is passed the first time: all
    # overflow of points up to its own. Those behind the last node belong to the first.
    by_point = F.struct("point", "place", "home", "n", "kept", "before", "line")
    one = at.agg(
        F.array_sort(F.collect_list(by_point)).alias("at"), F.sum("n").alias("total"), F.sum(F.col("n") - F.col("kept")).alias("over"))
    homes = at.groupBy("home").agg(F.sum("kept").alias("kept"))
    used = homes.agg(F.map_from_entries(F.collect_list(F.struct("home", "kept"))).alias("used"))
    # Two rows, one each.
    one = one.withColumn("k", F.lit(0)).join(used.withColumn("k", F.lit(0)), "k")
    shard = F.sequence(F.lit(0), F.lit(shards - 1))
    home_rows = F.transform(shard, lambda s: F.coalesce(F.element_at("used", s), F.lit(0).cast("long")))
    one = one.withColumn("home_rows", home_rows).withColumn(
        "free", F.transform(shard, lambda s: quota(F.col("total"), s, shards) - F.element_at("home_rows", s + 1)))
    # The last point of each node's stretch, in order of the ring.
    ends = F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.try_element_at("at", i + 2)["place"] != p["place"]))
    first = F.transform(ends, lambda p: F.struct(p["home"].alias("shard"), (p["line"] + p["n"] - p["kept"]).alias("entered")))
    again = F.transform(ends, lambda p: F.struct(p["home"].alias("shard"), F.col("over").alias("entered")))
    one = one.withColumn("takes", walk(F.concat(first, again), F.col("free"), F.col("over")))
    # Slots behind those of a shard's own rows, in order of the line.
    slots = F.aggregate(
        "takes", F.struct(F.col("home_rows").alias("next"), F.array().cast(
            "array<struct<lo:bigint,hi:bigint,shard:int,slot:bigint>>").alias("out")),
        lambda s, t: F.struct(
            F.transform(s["next"], lambda x, i: F.when(i == t["shard"], x + t["hi"] - t["lo"]).otherwise(x)).alias("next"),
            F.concat(s["out"], F.array(F.struct(t["lo"], t["hi"], t["shard"], F.element_at(s["next"], t["shard"] + 1).alias("slot")))).alias("out"),
        ))["out"]
    # Written, or each point below would walk the ring again.
    one = settle(one.select("at", slots.alias("takes")), "ring-takes")

    def spans(p):
        home = F.struct(F.lit(0).cast("long").alias("lo"), p["home"].alias("shard"), p["before"].alias("slot"))
        end = p["line"] + p["n"] - p["kept"]
        met = F.filter("takes", lambda t: (t["lo"] < end) & (t["hi"] > p["line"]))
        away = F.transform(met, lambda t: F.struct(
            (F.greatest(t["lo"], p["line"]) - p["line"] + p["kept"]).alias("lo"), t["shard"].alias("shard"),
            (t["slot"] + F.greatest(t["lo"], p["line"]) - t["lo"]).alias("slot")))
        empty = F.array().cast("array<struct<lo:bigint,shard:int,slot:bigint>>")
        return F.struct(p["point"].alias("point"), F.concat(
            F.when(p["kept"] > 0, F.array(home)).otherwise(empty), F.when(end > p["line"], away).otherwise(empty)).alias("spans"))

    return one.select(F.explode(F.transform(F.filter("at", lambda p: p["n"] > 0), spans)).alias("p")).select("p.*")


def shard_rows(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, points: int = POINTS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, home, shard, slot, grown_shard.

    ``docs`` has doc_id and text, other columns are ignored; a NULL text has no
    bytes. The law is ``rows``: counts are at most one apart, so ``grown_shard`` is
    NULL. ``home`` is the shard before overflow. ``slot`` counts a shard's rows from
    0 without gaps. Equal rows are interchangeable: they are counted, placed and
    unfolded again, so a row that repeats very often is no hot group. NULL ids and
    repeated ids are placed by id, size and checksum together. Fewer rows than
    shards leave shards empty; an empty table gives an empty result.
    """
    if not 0 < shards * nodes <= points // 4:
        raise ValueError("the ring needs four points for each node at least")
    spark = docs.sparkSession
    rows = settle(distinct_rows(id_and_text(docs), points), "ring-rows")
    counts = rows.groupBy("point").agg(F.sum("copies").alias("n"))
    places = settle(ring(spark, shards, nodes, points), "ring")
    # One row per ring point.
    plan = F.broadcast(settle(allocate(counts, places, shards).join(places.select("point", "home"), "point"), "ring-plan"))
    before = Window.partitionBy("point").orderBy("doc_id", "size", "text_crc32", "lot").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("rank", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    each = ranked.withColumn("rank", F.explode(F.sequence(F.col("rank"), F.expr("rank + copies - 1")))).join(plan, "point")
    span = F.element_at(F.filter("spans", lambda s: s["lo"] <= F.col("rank")), -1)
    return each.withColumn("span", span).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "home", F.col("span.shard").alias("shard"),
        (F.col("span.slot") + F.col("rank") - F.col("span.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
