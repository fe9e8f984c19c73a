"""Inverted term index as a table, and searching through it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinderlog.functions import text
from cinderlog.operators import search


def term_index(logs: DataFrame, config: str = "english") -> DataFrame:
    """One row per distinct term of a body: (term, event_date, id)."""
    return logs.select(
        F.explode(text.terms(F.col("body"), config)).alias("term"), F.to_date("timestamp").alias("event_date"), "id"
    )


def write_term_index(index: DataFrame, path: str) -> None:
    """Write the index by day, sorted by term inside each file.

    Days are split by size, not by term, so a term that occurs in a third of
    all rows is spread over as many files as its day.
    """
    balanced = index.hint("rebalance", F.col("event_date"))
    balanced.sortWithinPartitions("event_date", "term", "id").write.mode("overwrite").partitionBy(
        "event_date"
    ).parquet(path)


def matching_ids(index: DataFrame, keyword: str, config: str = "english", start=None, end=None) -> DataFrame:
    """Ids whose rows hold every term of the keyword; none for a keyword of stop words.

    The keyword's few terms are read on the driver so that the term filter can
    skip row groups of the sorted index. With ``start`` and ``end`` only the days
    between them are read.
    """
    if start is not None and end is not None:
        index = index.where(search.in_days(start, end))
    wanted = text.query_terms(keyword, config)
    rows = index.where(F.col("term").isin(wanted) if wanted else F.lit(False))
    if len(wanted) <= 1:
        return rows.select("id")
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("id")


# Postings: for each term, day and bucket of 32,768 ids the places of its ids in the bucket, ascending.
BUCKET_BITS = 15
POSTINGS_DDL = "term string, bucket bigint, places array<int>, event_date date, load string"


def postings(logs: DataFrame, config: str = "english") -> DataFrame:
    """(term, event_date, bucket, places) of the bodies.

    A bucket bounds every list, whatever the term's frequency. Lists grow per task
    before the shuffle; dense ids make few of them.
    """
    place = F.col("id").bitwiseAND((1 << BUCKET_BITS) - 1).cast("int")
    return term_index(logs, config).groupBy("term", "event_date", F.shiftright("id", BUCKET_BITS).alias("bucket")).agg(
        F.sort_array(F.collect_list(place)).alias("places")
    )


def merge_postings(rows: DataFrame) -> DataFrame:
    """Postings of several loads as those of one."""
    return rows.groupBy("term", "event_date", "bucket").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))


def posted_ids(index: DataFrame, keyword: str, config: str, start, end) -> DataFrame:
    """(event_date, id) of rows that hold every term of the keyword, from postings of several loads.

    Only lists of the keyword's terms are read, of the days between ``start`` and
    ``end``; the lists of one bucket meet and are intersected. A keyword of stop words finds nothing.
    """
    wanted = text.query_terms(keyword, config)
    near = index.where(search.in_days(start, end)).where(F.col("term").isin(wanted) if wanted else F.lit(False))
    met = near.groupBy("event_date", "load", "bucket").agg(F.collect_list("places").alias("lists"))
    common = F.aggregate("lists", F.element_at("lists", 1), F.array_intersect)
    full = met.where(F.size("lists") == len(wanted)).select("event_date", "bucket", F.explode(common).alias("place"))
    return full.select("event_date", (F.shiftleft("bucket", BUCKET_BITS) + F.col("place")).alias("id"))
